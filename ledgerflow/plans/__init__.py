"""Named queries over the stand-in views and their DuckDB oracles."""
