"""Following changes as they come."""
