"""Digest analytics on Spark."""
