"""Register-data plans."""
