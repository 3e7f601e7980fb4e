"""The ingest job as a stream of micro-batches, and daily windows."""
