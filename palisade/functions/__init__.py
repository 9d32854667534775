"""Column expressions: scoring, time arithmetic, text clean-up."""
