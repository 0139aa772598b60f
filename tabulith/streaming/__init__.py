"""Loading exchange rows as they arrive."""
