"""Plans: how the test tables play the roles of the original workload, and
the registry of end-to-end queries (each with its DuckDB oracle text)."""
