"""Files as DataFrames."""
