"""Product-event ingest, lake, catalog and metric analytics on Spark DataFrames."""
