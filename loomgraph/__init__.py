"""loomgraph: overlapping community detection and graph analytics on Spark DataFrames."""
