"""Column expressions: text preparation and metric arithmetic."""
