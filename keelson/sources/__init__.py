"""Index tables, manifests and delete files."""
