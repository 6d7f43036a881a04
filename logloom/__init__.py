"""Log ingest, listing, counting and retention as Spark jobs."""
