"""Repository intelligence on Spark: a snapshotted fact store, a typed code graph,
search, ranking, budgeted packing and architecture policies as DataFrame plans."""
