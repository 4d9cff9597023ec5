"""Queries over the test tables, each with the SQL that computes the same result."""
