"""Set-oriented building blocks; every one maps DataFrames to DataFrames."""
