"""Business analytics over relational tables, written as Spark DataFrame functions."""
