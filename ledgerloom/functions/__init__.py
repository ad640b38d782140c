"""Column expressions: money, dates, text keys, numbers, geometry, hashing."""
