"""Spark-native engine for curating and analysing directories of contact records."""
