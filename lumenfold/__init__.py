"""lumenfold: density grouping of numeric point tables on Spark DataFrames."""
