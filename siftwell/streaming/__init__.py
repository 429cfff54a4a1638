"""Structured Streaming forms of the usage log. An extension: evaluation itself runs on bounded tables."""
