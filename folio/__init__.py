"""A Spark-first engine for a research-paper catalog and its document pipeline."""
