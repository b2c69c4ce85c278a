"""A document analytics engine on PySpark."""
