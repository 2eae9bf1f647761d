"""vecgrove: nearest-neighbour analytics with typed filtering, planned as Spark DataFrames."""
