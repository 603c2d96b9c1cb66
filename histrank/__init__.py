"""histrank: sequential-recommendation data processing on PySpark DataFrames."""
