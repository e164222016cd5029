"""Clustering and vector quantisation on Spark."""
