"""Column functions: typed JSON access, previews, summaries, costs, display formats."""
