"""Reading names and writing results."""
