"""A PySpark-native engine for duplicated and near-duplicated code and text."""
