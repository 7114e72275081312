"""The same queries as SQL for DuckDB: the independent side of the correctness check."""
