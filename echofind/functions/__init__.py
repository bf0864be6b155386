"""Column functions: expressions that Catalyst plans, no user functions on the main path."""
