"""The ingest job as a stream, and the counts it keeps per minute."""
