"""chronoloom: a PySpark-native engine for keyed, ordered time-series tables."""
