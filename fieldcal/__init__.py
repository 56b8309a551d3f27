"""Gridded forecast post-processing and verification as Spark jobs."""
