"""Streaming of the document retrieval engine."""
