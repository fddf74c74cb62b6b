"""wayspan: temporal bipartite graph analytics on Spark DataFrames."""
