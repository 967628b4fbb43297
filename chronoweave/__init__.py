"""Valid-time property graphs on Spark DataFrames."""
