"""Whole plans: detection, models, experiments, and the registered queries."""
