"""Column expressions and the small per-row / per-group numeric helpers."""
