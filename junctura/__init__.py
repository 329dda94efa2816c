"""A PySpark-native engine for structural-variant and gene-fusion evidence."""
