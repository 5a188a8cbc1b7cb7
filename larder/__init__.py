"""Retail replenishment analytics on Spark, and operators for training-data pipelines."""
