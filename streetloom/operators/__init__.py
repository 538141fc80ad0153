"""Graph construction, traversal, clustering, coarsening and search over DataFrames."""
