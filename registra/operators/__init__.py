"""Register-data operators."""
