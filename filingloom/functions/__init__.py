"""Column to column functions: periods, currency, labels, guards, vectors."""
