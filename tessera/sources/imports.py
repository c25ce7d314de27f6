"""owl:imports: one level, or everything that is reachable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.closure import closure, components, materialize
from ..operators.pairs import all_pairs
from ..operators.patterns import match


def direct_imports(triples: DataFrame) -> DataFrame:
    """model, imported."""
    return match(triples, p="owl:imports").select(F.col("s").alias("model"), F.col("o").alias("imported")).distinct()


def import_closure(triples: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """model, imported, depth; models that import each other in a circle end once all are seen.

    ``roots`` (a column ``model``): the models to start from, as a user loads some; the work grows with what they reach. Without,
    pairs are made as they are read: see ``pairs.all_pairs``.
    """
    direct = direct_imports(triples)
    found = all_pairs(direct, "model", "imported") if roots is None else closure(direct, "model", "imported", roots.select(F.col("model").alias("a")))
    return found.select(F.col("a").alias("model"), F.col("b").alias("imported"), "depth")


def import_components(triples: DataFrame) -> DataFrame:
    """model, component, size: models that import each other, directly or not, are one component, named by its smallest."""
    found = materialize(components(direct_imports(triples).select(F.col("model").alias("a"), F.col("imported").alias("b"))))
    return found.join(found.groupBy("component").agg(F.count("*").alias("size")), "component").select(F.col("node").alias("model"), "component", "size")


def component_links(triples: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """component, imported, n: imports between different components; without circles, so whatever is asked of a component
    holds for all of its models."""
    parts = import_components(triples) if parts is None else parts
    side = lambda model, name: parts.select(F.col("model").alias(model), F.col("component").alias(name))
    links = direct_imports(triples).join(side("model", "c"), "model").join(side("imported", "d"), "imported").where("c <> d")
    return links.groupBy(F.col("c").alias("component"), F.col("d").alias("imported")).agg(F.count("*").alias("n"))


def reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """model: what any of the ``roots`` (model) imports, directly or not, over ``edges`` (model, imported). The roots count as
    one start, so the work is a row for each model and not for each pair."""
    start = F.lit("")
    steps = edges.select("model", "imported").unionByName(roots.select(start.alias("model"), F.col("model").alias("imported")))
    met = closure(steps, "model", "imported", roots.select(start.alias("a")).distinct()).select(F.col("b").alias("model"))
    return edges.join(met, "model", "left_semi").select(F.col("imported").alias("model")).distinct()


def with_imports(triples: DataFrame, catalogue: DataFrame, root: str | None = None, closed: bool = False) -> DataFrame:
    """``triples`` of the model ``root``, or of all models in them, with those of the models they import.

    ``catalogue``: model and its triples. Imports that the catalogue lacks are left out. With ``closed``
    everything reachable through the catalogue comes in, else one level.
    """
    columns, own = triples.columns, direct_imports(triples)
    roots = own.select("model").distinct() if root is None else triples.sparkSession.createDataFrame([(root,)], "model string")
    if closed:
        wanted = reached(direct_imports(catalogue).unionByName(own).distinct(), roots)
    else:
        wanted = own.join(roots, "model", "left_semi").select(F.col("imported").alias("model"))
    return triples.unionByName(catalogue.join(wanted, "model", "left_semi").select(*columns)).dropDuplicates(columns)
