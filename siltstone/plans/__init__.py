"""DataFrame plans."""
