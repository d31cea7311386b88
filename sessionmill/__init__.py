"""Analytics over append-only JSONL session logs of coding agents, on Spark."""
