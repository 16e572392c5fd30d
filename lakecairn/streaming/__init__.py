"""Change feeds into a versioned table."""
