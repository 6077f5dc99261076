"""Column expressions: calendar flags, planning arithmetic, advisory wording."""
