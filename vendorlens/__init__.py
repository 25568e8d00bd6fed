"""Digital-footprint analytics over mail metadata, expressed as Spark DataFrames."""
