"""Array analytics and machine-learning data processing on Spark DataFrames."""
