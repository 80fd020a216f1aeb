"""A web-search analytics engine on Spark: extraction, indexing, retrieval, ranking, crawl planning."""
