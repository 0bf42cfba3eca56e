"""Queries over the given tables, with the SQL to check them by."""
