"""Feature engineering and analytics on Spark DataFrames."""
