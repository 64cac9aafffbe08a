"""Governed data operators on Spark."""
