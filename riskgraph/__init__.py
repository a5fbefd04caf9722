"""Change-risk and vulnerability-reachability analytics on Spark DataFrames."""
