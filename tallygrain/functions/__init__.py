"""Column expressions, distributed ranking and distribution tails."""
