"""The query catalog, its tables and run options."""
