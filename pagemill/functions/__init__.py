"""Column functions: URLs, HTML, predicates."""
