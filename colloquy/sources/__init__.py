"""Sources: bundle reader and gates, table scans, fixture bindings."""
