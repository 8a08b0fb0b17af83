"""Click-log feature engineering on Spark DataFrames."""
