"""DataFrame streaming."""
