"""Dataset curation on Spark: every operator is a function from DataFrame to DataFrame."""
