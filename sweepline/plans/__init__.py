"""Composed pipelines, bindings to the test tables and the query catalog."""
