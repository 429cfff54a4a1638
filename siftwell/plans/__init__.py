"""Chains of operators: from documents to chunks, and from questions to metrics."""
