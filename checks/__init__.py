"""Registered queries: each pairs a Spark job over the given tables with the SQL that checks it."""
