"""Register-data streaming."""
