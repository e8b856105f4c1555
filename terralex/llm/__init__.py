"""Operators for preparing training corpora, their registered queries and the SQL that checks them."""
