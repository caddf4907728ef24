"""Sources of the document retrieval engine."""
