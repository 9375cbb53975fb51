"""Readers, extractors, durable stores and sinks."""
