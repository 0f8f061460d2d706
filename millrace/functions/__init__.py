"""Column functions: text cleanup, numbers, dates, hashes."""
