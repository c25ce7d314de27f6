"""Ontology analytics on Spark."""
