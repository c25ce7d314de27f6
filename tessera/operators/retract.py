"""Truth functions, and the fold that takes back entities which can't be stated.

A restriction without owl:onProperty goes, and what needs it goes after it, round by round: a restriction whose filler,
a complement whose operand, or a truth function all of whose members are gone. A round starts from what went in the
last one alone and looks again only at the lists that hold it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rules import below
from ..vocab import iri
from .closure import materialize
from .patterns import match, with_predicates

BOOLEAN = ["owl:intersectionOf", "owl:unionOf"]
#: Predicates whose one object a blank restriction can't do without.
NEEDED = ["owl:someValuesFrom", "owl:allValuesFrom", "owl:onClass", "owl:onDataRange"]


def orphans(triples: DataFrame, found: DataFrame) -> DataFrame:
    """id, cls of blank quantifiers and cardinalities without owl:onProperty."""
    bound = match(triples, p="owl:onProperty").select(F.col("s").alias("id")).distinct()
    return found.where(F.col("cls").isin(below("PropertyConceptRestriction")) & (F.col("id_kind") == "bnode")).select("id", "cls").join(bound, "id", "left_anti")


def unresolved(triples: DataFrame, found: DataFrame) -> DataFrame:
    """id, cls of quantifiers and cardinalities that stay but have no property: named ones without owl:onProperty, and those
    for which it leads to literals alone."""
    bound = match(triples, p="owl:onProperty").groupBy(F.col("s").alias("id")).agg(F.max(F.col("o_kind") != "literal").alias("resolved"))
    own = found.where(F.col("cls").isin(below("PropertyConceptRestriction"))).select("id", "id_kind", "cls").join(bound, "id", "left")
    return own.where("not coalesce(resolved, false) and (id_kind = 'iri' or resolved is not null)").select("id", "cls")


def functions(triples: DataFrame, found: DataFrame) -> DataFrame:
    """owner, node, operator, head, own: every truth function and the node that bears it.

    A node of class TruthFunction bears its own. Of a Concept the list's first node does, and for a complement a blank node
    named by owner and operand; the Concept is equivalent to that node. Other classes have none.
    """
    kinds = found.where(F.col("cls").isin("TruthFunction", "Concept")).groupBy(F.col("id").alias("s")).agg(F.max(F.col("cls") == "TruthFunction").alias("own"))
    used = with_predicates(triples, *BOOLEAN, "owl:complementOf").where("o_kind <> 'literal'").join(kinds, "s")
    operator = F.when(F.col("p") == iri("owl:intersectionOf"), "and").when(F.col("p") == iri("owl:unionOf"), "or").otherwise("not")
    apart = F.concat(F.lit("_:n"), F.substring(F.sha2(F.concat_ws("\n", "s", "o"), 256), 1, 32))
    return used.select(F.col("s").alias("owner"), F.when(F.col("own"), F.col("s")).when(operator == "not", apart).otherwise(F.col("o")).alias("node"), operator.alias("operator"), F.col("o").alias("head"), "own").distinct()


def members(truths: DataFrame, items: DataFrame) -> DataFrame:
    """node, idx, item: operands of ``functions``; complements have one, at 0."""
    listed = truths.where("operator <> 'not'").join(items, "head").select("node", "idx", "item")
    return listed.unionByName(truths.where("operator = 'not'").select("node", F.lit(0).cast(listed.schema["idx"].dataType).alias("idx"), F.col("head").alias("item"))).distinct()


def retracted(triples: DataFrame, items: DataFrame, found: DataFrame) -> DataFrame:
    """id, round of the nodes that go: orphans in round 0, then what can't be stated without them."""
    truths = functions(triples, found)
    operands = materialize(members(truths, items).select("node", "item").distinct())
    blank = found.where((F.col("id_kind") == "bnode") & F.col("cls").isin(below("Restriction"))).select(F.col("id").alias("node"))
    single = materialize(with_predicates(triples, *NEEDED).where("o_kind = 'bnode'").select(F.col("s").alias("node"), F.col("o").alias("item")).join(blank, "node", "left_semi").distinct())
    last = materialize(orphans(triples, found).select("id", F.lit(0).alias("round")).distinct())
    gone, number = last, 0
    while not last.isEmpty():
        number += 1
        went = last.select(F.col("id").alias("item"))
        touched = operands.join(operands.join(went, "item", "left_semi").select("node").distinct(), "node", "left_semi")
        left = touched.join(gone.select(F.col("id").alias("item")), "item", "left_anti").select("node")
        new = single.join(went, "item", "left_semi").select("node").unionByName(touched.select("node").join(left, "node", "left_anti")).distinct()
        last = materialize(new.select(F.col("node").alias("id")).join(gone, "id", "left_anti").withColumn("round", F.lit(number)))
        gone = gone.unionByName(last)
    return gone


def truth_values(triples: DataFrame, items: DataFrame, found: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """id, attr, ord, v of truth functions over the members that stay.

    None gives nothing. A Concept with one member is equivalent to that member; with more, or with a complement, to the
    node that bears operator and operands. A TruthFunction has operator and operands itself, however many.
    """
    truths = functions(triples, found)
    operands = members(truths, items)
    if gone is not None:
        away = gone.select("id").distinct()
        operands = operands.join(away.withColumnRenamed("id", "item"), "item", "left_anti")
        truths = truths.join(away.withColumnRenamed("id", "owner"), "owner", "left_anti").join(away.withColumnRenamed("id", "node"), "node", "left_anti")
    counted = operands.groupBy("node").agg(F.count("*").alias("n"), F.min("item").alias("only"))
    full = truths.join(counted, "node")
    alone = ~F.col("own") & (F.col("operator") != "not") & (F.col("n") == 1)
    row = lambda df, id, attr, ord, v: df.select(F.col(id).alias("id"), F.lit(attr).alias("attr"), F.lit(ord).cast("int").alias("ord") if isinstance(ord, int) else F.col(ord).cast("int").alias("ord"), F.col(v).alias("v"))
    bearing = full.where(~alone)
    out = row(bearing, "node", "has_logical_operator", 0, "operator")
    out = out.unionByName(row(bearing.select("node").distinct().join(operands, "node"), "node", "applies_on_concept", "idx", "item"))
    out = out.unionByName(row(full.where(alone), "owner", "is_equivalent_to", 0, "only"))
    return out.unionByName(row(bearing.where(~F.col("own")), "owner", "is_equivalent_to", 0, "node")).distinct()


def truth_nodes(truths: DataFrame, found: DataFrame) -> DataFrame:
    """id, id_kind, cls of the nodes in ``truth_values`` that bear the truth functions of Concepts, and so have no class yet."""
    bearing = truths.where("attr = 'has_logical_operator'").select("id").distinct()
    return bearing.join(found.select("id"), "id", "left_anti").select("id", F.lit("bnode").alias("id_kind"), F.lit("TruthFunction").alias("cls"))


def kept(values: DataFrame, gone: DataFrame) -> DataFrame:
    """``values`` (id, v) without those of nodes that went and those that point at them."""
    away = gone.select("id").distinct()
    return values.join(away, "id", "left_anti").join(away.withColumnRenamed("id", "v"), "v", "left_anti").select(*values.columns)
