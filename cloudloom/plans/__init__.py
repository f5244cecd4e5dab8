"""Registered queries by subject, each with the SQL that gives the same rows."""
