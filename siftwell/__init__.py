"""siftwell: a Spark-first engine for search-result research data."""
