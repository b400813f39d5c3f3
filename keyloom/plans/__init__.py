"""Queries over the test tables, one for each operator, beside the SQL that gives the same rows."""
