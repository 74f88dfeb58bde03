"""Graph operators over pairs of DataFrames."""
