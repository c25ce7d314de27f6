"""Streams of triples."""
