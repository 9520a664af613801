"""The pipeline, its command line, and the query catalogue."""
