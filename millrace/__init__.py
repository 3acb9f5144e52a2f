"""millrace: a PySpark-native analytics engine for tables, property graphs and retrieval."""
