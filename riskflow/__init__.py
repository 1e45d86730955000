"""Transaction-risk analytics on Spark: cleaning, warehouse, features, scoring, drift and graph jobs."""
