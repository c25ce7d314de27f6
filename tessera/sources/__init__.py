"""Readers, validation and caching of RDF artefacts."""
