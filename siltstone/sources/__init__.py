"""DataFrame sources."""
