"""dunlin: an xBase-dialect analytics engine that compiles to Spark DataFrames."""
