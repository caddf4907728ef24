"""Column functions: text, identity, predicates."""
