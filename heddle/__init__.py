"""Heddle: header-indexing analytics and training-data preparation on Spark."""
