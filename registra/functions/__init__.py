"""Register-data functions."""
