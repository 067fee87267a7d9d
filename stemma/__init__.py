"""Analytics over ordered token arrays that evolve along trees, on Spark DataFrames."""
