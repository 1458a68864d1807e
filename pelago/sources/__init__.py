"""Foreign tables."""
