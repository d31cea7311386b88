"""Sessions rendered as training records and transcripts."""
