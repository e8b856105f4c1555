"""Bilingual entity collections, vector search and retrieval evaluation on Spark."""
