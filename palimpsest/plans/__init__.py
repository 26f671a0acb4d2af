"""Queries over the operators, with the SQL that each is held against."""
