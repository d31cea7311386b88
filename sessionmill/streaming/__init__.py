"""Structured Streaming versions of the session queries."""
