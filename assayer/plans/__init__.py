"""Named queries and their DuckDB twins."""
