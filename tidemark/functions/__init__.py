"""Column expressions: keys, records, filters' formulas."""
