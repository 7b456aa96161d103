"""Market-data analytics on Spark: every operator takes and returns a DataFrame."""
