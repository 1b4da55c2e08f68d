"""Reading, writing and changing tables."""
