"""Column functions: text, hashing, numbers, time."""
