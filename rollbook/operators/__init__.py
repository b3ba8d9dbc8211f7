"""Table-to-table operators. Each takes and returns DataFrames and runs nothing by itself unless its text says so.

"First" always means first by an explicit order column (default `_ord`), which must be unique per row.
"""
