"""The query surface: named queries, adapters for other tables, and the checks that go with them."""
