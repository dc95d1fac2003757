"""A Spark-native engine for finding, reviewing and pseudonymising confidential spans in text tables."""
