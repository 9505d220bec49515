"""A PySpark engine for harvested bibliographic records."""
