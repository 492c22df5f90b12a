"""The same work on unbounded input."""
