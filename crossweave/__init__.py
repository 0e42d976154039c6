"""Trend analytics over corpora of short, timestamped records, as Spark jobs."""
