"""countlake: sparse integer count matrices and their geometry tables as Spark DataFrames."""
