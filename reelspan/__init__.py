"""Analytics over corpora of timed transcripts, written as PySpark DataFrame operations."""
