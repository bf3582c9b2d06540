"""Spark-native analytics over corpora of source code, documents, tables and journals."""
