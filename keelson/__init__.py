"""Relational-integrity analytics for lakehouse tables, written for Spark."""
