"""Structure analytics on Spark: rules, graphs, clones and metrics over tables of paths and texts."""
