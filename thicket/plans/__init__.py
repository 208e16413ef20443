"""The queries, by kind."""
