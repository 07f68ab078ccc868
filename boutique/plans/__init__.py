"""Named query plans: the registry used by the driver contract and the DuckDB oracle."""
