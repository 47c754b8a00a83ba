"""strandfold: exact k-mer counting on Spark DataFrames."""
