"""Column functions and text transforms."""
