"""DataFrame operators: each takes and returns DataFrames and leaves the physical strategy to Spark."""
