"""Point-cloud analytics on PySpark."""
