"""Composed pipelines, data products and the registered queries."""
