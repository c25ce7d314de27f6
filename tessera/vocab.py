"""Namespaces and term lists of the RDF vocabularies."""

from __future__ import annotations

# Namespace addresses.
PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "swrl": "http://www.w3.org/2003/11/swrl#",
}

# Namespaces whose predicates populate entities, for each dialect.
DIALECT_NAMESPACES = {"owl": ["rdf", "rdfs", "owl", "xsd", "swrl"], "rdf": ["rdf", "rdfs"], "skos": ["rdf", "rdfs", "skos"]}

# Datatypes that are datatypes without a declaration, besides all of xsd.
BUILTIN_DATATYPES = ["rdfs:Literal", "rdf:XMLLiteral", "rdf:HTML", "rdf:PlainLiteral", "rdf:langString", "rdf:JSON", "owl:real", "owl:rational"]

# Predicates that never become statements.
STRUCTURAL_PREDICATES = ["rdf:first", "rdf:rest", "rdf:nil", "owl:members", "owl:distinctMembers"]

# Facet -> comparator.
FACETS = {
    "xsd:minInclusive": ">=", "xsd:maxInclusive": "<=", "xsd:minExclusive": ">", "xsd:maxExclusive": "<",
    "xsd:pattern": "pattern", "xsd:length": "length", "xsd:minLength": "minLength", "xsd:maxLength": "maxLength",
}


def iri(curie: str) -> str:
    """``owl:Class`` -> the full IRI; other strings are returned as they are."""
    prefix, colon, name = curie.partition(":")
    return PREFIXES[prefix] + name if colon and prefix in PREFIXES else curie


def iris(*curies: str) -> list[str]:
    return [iri(c) for c in curies]
