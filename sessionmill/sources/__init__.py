"""Readers of log trees, in batch and as a growing stream."""
