"""Column functions: exact integer helpers, constant tables and block mathematics."""
