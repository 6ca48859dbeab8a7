"""Sources: file manifest, charset detection, CSV ingest, test-data views."""
