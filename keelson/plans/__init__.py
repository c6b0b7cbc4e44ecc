"""Driver-side planning: domains, chains, commits."""
