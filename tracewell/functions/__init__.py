"""Column expressions over log text."""
