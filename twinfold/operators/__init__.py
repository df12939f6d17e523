"""Set-oriented operators: DataFrames in, DataFrames out."""
