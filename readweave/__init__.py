"""Reading-aware string comparison, fuzzy matching and training-data operators on Spark DataFrames."""
