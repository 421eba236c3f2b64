"""Table profiling, hybrid retrieval, identifier audits and result scoring on Spark."""
