"""End-to-end runs and the query registry."""
