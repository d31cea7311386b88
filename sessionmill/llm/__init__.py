"""Corpus operators for large training-data pipelines, one module each.

Nothing outside this package imports it, so it can be removed as a whole.
"""
