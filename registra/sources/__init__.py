"""Register-data sources."""
