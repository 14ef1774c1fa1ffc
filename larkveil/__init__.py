"""larkveil: sensitive-text analytics and training-data preparation on Spark DataFrames."""
