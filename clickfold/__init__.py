"""Product-event analytics on PySpark: ingest, metrics, marts and serving queries."""
