"""DataFrame functions."""
