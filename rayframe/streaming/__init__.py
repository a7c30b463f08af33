"""Streams of requests around a running reconstruction."""
