"""registra: substance-register analytics on Spark DataFrames."""
