"""Triple patterns, existence and namespace filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import namespace_of
from ..rules import below, namespaces
from ..vocab import PREFIXES, iri


def match(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Triples with the given terms; CURIEs are expanded."""
    for name, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            triples = triples.where(F.col(name) == iri(value))
    return triples


def with_predicates(triples: DataFrame, *curies: str) -> DataFrame:
    return triples.where(F.col("p").isin([iri(c) for c in curies]))


def value(triples: DataFrame, p: str) -> DataFrame:
    """One object for each subject: the smallest by language and value."""
    return match(triples, p=p).groupBy("s").agg(F.min(F.struct("o_lang", "o")).alias("m")).select("s", F.col("m.o").alias("o"))


def having(left: DataFrame, key: str, triples: DataFrame, p: str, o: str | None = None) -> DataFrame:
    """Rows of ``left`` whose ``key`` is a subject of (p, o)."""
    return left.join(match(triples, p=p, o=o).select(F.col("s").alias(key)).distinct(), key, "left_semi")


def in_namespaces(triples: DataFrame, dialect: str) -> DataFrame:
    return triples.where(namespace_of(F.col("p")).isin(namespaces(dialect)))


def not_structural(column: str):
    """No term of rdf, rdfs, owl, skos or xsd."""
    out = F.lit(True)
    for name in ("rdf", "rdfs", "owl", "skos", "xsd"):
        out = out & ~F.col(column).startswith(PREFIXES[name])
    return out


def of_class(entities: DataFrame, cls: str, exact: bool = False) -> DataFrame:
    """Entities of a class, or of it and its subclasses."""
    return entities.where(F.col("cls") == cls) if exact else entities.where(F.col("cls").isin(below(cls)))


def by_predicate(triples: DataFrame) -> DataFrame:
    return triples.groupBy("p").agg(F.count("*").alias("n"))


def by_namespace(triples: DataFrame, dialect: str) -> DataFrame:
    return in_namespaces(triples, dialect).groupBy(namespace_of(F.col("p")).alias("ns")).agg(F.count("*").alias("n"))
