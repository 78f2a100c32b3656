"""Finding and masking personal data and credentials in text, on Spark DataFrames."""
