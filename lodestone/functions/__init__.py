"""Column expressions used by the table jobs."""
