"""Sources and sinks: table scans, positional text columns, wide<->array vectors, CSV and parameter tables."""
