"""Serialisers and the static site."""
