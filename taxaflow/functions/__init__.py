"""Column expressions: no job runs here."""
