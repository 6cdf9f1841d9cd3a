"""Session analytics on Spark: scan, normalise, search, rank, trim and convert conversation transcripts."""
