"""PySpark queries over the supplied tables, built on the public DataFrame API."""
