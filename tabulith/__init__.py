"""Statistical-table warehouse operators on Spark DataFrames."""
