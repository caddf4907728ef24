"""Plans of the document retrieval engine."""
