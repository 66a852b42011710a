"""Column expressions: clocks, geography, flags and encodings."""
