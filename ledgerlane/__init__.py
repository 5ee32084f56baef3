"""Order and lifecycle-event analytics with explicit data quality, on Spark DataFrames."""
