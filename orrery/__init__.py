"""orrery: a PySpark-native catalogue query engine and corpus toolkit."""
