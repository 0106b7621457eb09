"""Many-body sums, octrees and their relations on Spark DataFrames."""
