"""Queries over the given tables, one per operator, and the SQL each must agree with."""
