"""Shop operators: each takes a Tables bundle (or DataFrames) and returns a lazy DataFrame."""
