"""Column builders. Every function returns a ``pyspark.sql.Column`` made of
built-in expressions; there is no Python code in the row path."""
