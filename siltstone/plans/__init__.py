"""Queries over the driver's tables, with the SQL that each is checked against."""
