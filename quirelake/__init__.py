"""Book and document flows as Spark DataFrames."""
