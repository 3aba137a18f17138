"""DataFrame operators: chunking, indexing, retrieval, reranking, answering, metrics and analytics."""
