"""Document search and curation on Spark."""
