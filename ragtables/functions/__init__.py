"""Column functions: text, queries, vectors, citations."""
