"""Operators: retrieval, catalogue, chunking, parsing, deduplication, context, answers, jobs."""
