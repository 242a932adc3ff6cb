"""Column functions on names, logs and code text."""
