"""What an entity's card shows: every value resolved to a text and a link, under names in a fixed order, and as JSON.

Relations are rows; a card that is folded, and an instance as JSON, comes in pieces of a bounded number of values, so that no
row grows with the number of values of one entity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import clean_name
from ..operators.closure import materialize
from ..operators.ordering import running_sums
from ..operators.statements import is_cell
from .views import best_labels, deprecated, in_language

# Names that come first on a card; classes that show as a text of their own; values that aren't shown.
FIRST_NAMES = ["is sub property of", "domain", "range", "is inverse Of", "property chain", "is disjoint with"]
RESTRICTIONS = ["Restriction", "PropertyConceptRestriction", "Quantifier", "Cardinality", "TruthFunction", "OneOf", "Value"]
NUMBERS = ["has_cardinality", "is_inverse"]
#: Values, or triples, that one piece of a card or of JSON has at most.
PIECE = 1000


def literal_attributes(dialect: str = "owl") -> list[str]:
    """Attributes whose values are literals, also where they read like an IRI."""
    return sorted({attr for r in rules.predicate_rules(dialect) for attr, kind in r.setters.items() if kind == "Literal"})


def hidden_attributes(dialect: str = "owl") -> list[str]:
    """Flags and numbers, which a card doesn't list among its relations."""
    return sorted({attr for _, _, attr, constant in rules.setter_rows(dialect) if constant in ("True", "False")} | set(NUMBERS))


def main_values(nested: DataFrame) -> DataFrame:
    """id, text: what a nested statement says in short, the innermost object of its slots."""
    return nested.where(F.col("path").rlike("^has_object0(/has_object0)*$")).groupBy("id").agg(F.min("v").alias("text"))


def known_nodes(triples: DataFrame, found: DataFrame, texts: DataFrame, nested: DataFrame, language: str = "en") -> DataFrame:
    """node, text, link, kind, is_deprecated of everything that a value may point at, one row a node.

    Restrictions have their text and no link, nested statements the text of their inner value, other entities their
    label and a link; the kind is the first class by name. Restrictions without a text have none here.
    """
    first = found.groupBy("id").agg(F.min("cls").alias("kind"))
    named = first.join(best_labels(triples, first, language), "id").join(texts.withColumnRenamed("text", "inner"), "id", "left").join(deprecated(triples), "id", "left")
    own = F.col("kind").isin(RESTRICTIONS)
    nodes = named.select(F.col("id").alias("node"), F.when(own, F.col("inner")).otherwise(F.col("label")).alias("text"), F.when(~own, F.col("id")).alias("link"), "kind", F.coalesce("is_deprecated", F.lit(False)).alias("is_deprecated"))
    inner = main_values(nested).join(first, "id", "left_anti").select(F.col("id").alias("node"), "text", F.lit(None).cast("string").alias("link"), F.lit("Statement").alias("kind"), F.lit(False).alias("is_deprecated"))
    return nodes.unionByName(inner)


def relations(values: DataFrame, nodes: DataFrame, language: str | None = "en", dialect: str = "owl") -> DataFrame:
    """id, rank, name, ord, text, link, lang, kind, is_deprecated: a row for each value that a card shows.

    Cards are read by ``rank`` (0 to 5 for the names that come first, 6 for the others) and ``name``. Literals of other
    languages go, untagged ones stay. Of what points at a node the text is the node's; other values are texts
    themselves. Blank nodes that nothing is known about, empty texts, flags and numbers don't show. One join looks
    values up; nodes have one row each, so a node that many values point at is split by Spark's skew join.
    """
    literal = F.col("attr").isin(literal_attributes(dialect))
    shown = in_language(values.where(~F.col("attr").isin(hidden_attributes(dialect))), language).withColumn("node", F.when(~literal, F.col("v")))
    met = shown.join(nodes, "node", "left").join(F.broadcast(_names(values)), "attr")
    blank = F.col("v").startswith("_:")
    rows = met.select(
        "id", "rank", "name", "ord", F.when(literal, F.col("v")).when(F.col("kind").isNotNull(), F.col("text")).when(~blank, F.col("v")).alias("text"),
        "link", "lang", F.when(literal, "Literal").otherwise(F.col("kind")).alias("kind"), F.coalesce("is_deprecated", F.lit(False)).alias("is_deprecated"),
    ).where("text <> ''")
    return rows.distinct()


def _names(values: DataFrame) -> DataFrame:
    """attr, name, rank of all attributes, which are as many as the rules have: names are made once for each, not a value."""
    name = clean_name(F.col("attr"))
    rank = F.lit(len(FIRST_NAMES))
    for place, first in reversed(list(enumerate(FIRST_NAMES))):
        rank = F.when(F.col("name") == first, place).otherwise(rank)
    return values.select("attr").distinct().withColumn("name", name).withColumn("rank", rank.cast("int"))


def _crowded(rows: DataFrame, size: int) -> DataFrame:
    """id of more than ``size`` rows. Only these are numbered in order; all others fit one piece.

    Rows are counted by a hash of the id first, so that ids needn't be dealt out; only those of full hashes are counted themselves.
    """
    hashed = rows.select("id", F.xxhash64("id").alias("_hash"))
    full = materialize(hashed.groupBy("_hash").agg(F.count("*").alias("n")).where(F.col("n") > size).select("_hash"))
    if full.isEmpty():
        return full.select(F.lit("").cast(rows.schema["id"].dataType).alias("id"))
    return materialize(hashed.join(full, "_hash", "left_semi").groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > size).select("id"))


def _numbered(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """``rows`` with ``piece``: from 0, with at most ``size`` rows of an id each, in order."""
    numbered = running_sums(rows.withColumn("_one", F.lit(1)), "_one", [F.col(c).asc_nulls_first() for c in order], ["id"])
    return numbered.withColumn("piece", F.floor((F.col("total") - 1) / size).cast("int")).drop("total", "_one")


def _pieces(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    rows = materialize(rows)
    crowded = _crowded(rows, size)
    few = rows.join(crowded, "id", "left_anti").select(*rows.columns, F.lit(0).alias("piece"))
    return few if crowded.isEmpty() else few.unionByName(_numbered(rows.join(crowded, "id", "left_semi").select(*rows.columns), order, size))


def folded(rows: DataFrame, size: int = PIECE) -> DataFrame:
    """id, piece, relations: cards as arrays of (rank, name, values) in reading order; long cards go on in further pieces."""
    columns = ["ord", "text", "link", "lang", "kind", "is_deprecated"]
    parts = _pieces(rows, ["rank", "name", *columns], size)
    listed = parts.groupBy("id", "piece", "rank", "name").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("values"))
    return listed.groupBy("id", "piece").agg(F.array_sort(F.collect_list(F.struct("rank", "name", "values"))).alias("relations"))


def instance_json(triples: DataFrame, found: DataFrame, values: DataFrame, size: int = PIECE) -> DataFrame:
    """id, piece, json of all entities ``found``: uri, classes, values by attribute and the triples with this subject.

    A piece has at most ``size`` values and triples, values first; an entity without any has one piece that lists none.
    Entities of one piece come together in one grouping with their classes; longer ones alone are put in order first. Nodes of
    lists are many and seldom entities, so their triples are only dealt out if they are.
    """
    inside = is_cell() & (F.col("s_kind") == "bnode")
    cells = materialize(triples.where(inside).join(found.where("id_kind = 'bnode'").select(F.col("id").alias("s")).distinct(), "s", "left_semi").select(*triples.columns))
    triples = triples.where(~inside).unionByName(cells)
    entries = values.select("id", F.lit(False).alias("is_triple"), F.col("attr").alias("a"), F.col("ord").cast("int").alias("ord"), F.col("v").alias("b"), "lang")
    entries = entries.unionByName(triples.select(F.col("s").alias("id"), F.lit(True).alias("is_triple"), F.col("p").alias("a"), F.lit(0).alias("ord"), F.col("o").alias("b"), F.coalesce("o_lang", F.lit("")).alias("lang")))
    classes = found.where("cls <> 'Literal'").select("id", "cls")
    order = ["is_triple", "a", "ord", "b", "lang"]
    crowded = _crowded(entries, size)
    few = entries.select("id", F.struct(*order).alias("entry"), F.lit(None).cast("string").alias("cls"))
    few = few.unionByName(classes.select("id", F.lit(None).cast(few.schema["entry"].dataType).alias("entry"), "cls")).join(crowded, "id", "left_anti").repartition("id")
    type_ = F.array_sort(F.collect_set("cls")).alias("type")
    whole = few.groupBy("id").agg(F.array_sort(F.collect_set("entry")).alias("all"), type_).where("size(type) > 0").withColumn("piece", F.lit(0))
    if not crowded.isEmpty():
        long = materialize(classes.join(crowded, "id", "left_semi").groupBy("id").agg(type_))
        parts = _numbered(entries.join(long.select("id"), "id", "left_semi").distinct(), order, size)
        together = parts.groupBy("id", "piece").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("all")).join(long, "id")
        whole = whole.unionByName(together.select(*whole.columns))
    valued = F.filter("all", lambda x: ~x["is_triple"])
    properties = F.map_from_entries(F.transform(F.array_distinct(F.transform(valued, lambda x: x["a"])), lambda a: F.struct(a, F.transform(F.filter(valued, lambda y: y["a"] == a), lambda y: y["b"]))))
    own = F.transform(F.filter("all", lambda x: x["is_triple"]), lambda x: F.struct(F.col("id").alias("subject"), x["a"].alias("predicate"), x["b"].alias("object")))
    return whole.select("id", "piece", F.to_json(F.struct(F.col("id").alias("uri"), "type", properties.alias("properties"), own.alias("rdf_triples"))).alias("json"))
