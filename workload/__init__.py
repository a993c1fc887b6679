"""Queries over the given tables: the Spark side and the SQL to check it with."""
