"""Joins and aggregations over matrices, images and projections."""
