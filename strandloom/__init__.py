"""Strandloom: retrieval, stitching and large-scale data operators for sequence search results on Spark."""

__version__ = "0.1.0"
