"""Column functions: text for people, bytes, and the forms of values."""
