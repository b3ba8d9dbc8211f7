"""Reading and writing tables, and finding columns by name."""
