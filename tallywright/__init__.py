"""A PySpark-native engine for transaction ledgers: DataFrame in, DataFrame out."""
