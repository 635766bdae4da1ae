"""Panel, matching and treatment operators on Spark DataFrames."""
