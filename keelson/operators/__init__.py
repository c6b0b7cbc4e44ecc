"""Dataflow operators over keys, rows and files."""
