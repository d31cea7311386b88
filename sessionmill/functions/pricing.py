"""Estimated cost of token usage by model family."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# US dollars per million tokens, by the first family whose name is part of the model's.
PRICES = (
    # family, input, output, cache read, cache creation
    ("opus", 15.0, 75.0, 1.50, 18.75),
    ("haiku", 1.0, 5.0, 0.10, 1.25),
    ("sonnet", 3.0, 15.0, 0.30, 3.75),
)
OTHER = PRICES[-1]
COUNTERS = ("input", "output", "cache_read", "cache_creation")


def price_of(model: Column, counter: str) -> Column:
    place = 1 + COUNTERS.index(counter)
    name = F.lower(F.coalesce(model, F.lit("")))
    chosen = F.lit(OTHER[place])
    for row in reversed(PRICES):
        chosen = F.when(F.contains(name, F.lit(row[0])), F.lit(row[place])).otherwise(chosen)
    return chosen


def estimated_cost(model: Column, usage: Column) -> Column:
    parts = [usage[c].cast("double") / F.lit(1e6) * price_of(model, c) for c in COUNTERS]
    return parts[0] + parts[1] + parts[2] + parts[3]
