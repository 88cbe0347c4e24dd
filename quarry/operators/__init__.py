"""DataFrame operators: chunking, retrieval, grounding, the parts catalog, and quality metrics."""
