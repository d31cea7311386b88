"""Operators over the event table: session facts, analytics, search, sidecar data."""
