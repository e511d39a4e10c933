"""Similarity exploration of large time-series collections as PySpark DataFrame jobs."""
