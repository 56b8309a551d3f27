"""Column expressions and the in-task numeric kernel."""
