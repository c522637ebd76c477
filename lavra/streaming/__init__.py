"""File-stream ingestion through the same plan (an extra: the batch operators do not need it)."""
