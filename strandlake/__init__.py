"""Read pileups, variants and intervals as Spark DataFrames."""
