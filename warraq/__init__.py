"""Batch analytics for multi-edition text corpora and transmission chains, as Spark jobs."""
