"""A PySpark-native engine for archives of semi-structured documents."""
