"""DataFrame operators: every function takes and returns lazy DataFrames."""
