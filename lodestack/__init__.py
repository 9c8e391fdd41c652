"""A PySpark-native analytics engine for linked, document-shaped catalogue data."""
