"""Partitioning of volumes and the statistics of partitionings."""
