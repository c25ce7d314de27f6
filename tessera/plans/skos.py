"""The view of a thesaurus: cards of collections and concepts, their definitions, sections of related concepts, other relations.

All parts are rows keyed by uri, so a collection with any number of members is no row of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import local_name
from .views import SECTIONS, in_language, literal_pick

# Attribute and title of each section of a card, in reading order; what a card shows elsewhere.
TITLES = {
    "has_member": "has members", "is_equivalent_to": "is equivalent to", "is_sub_concept_of": "has super-concepts", "is_disjoint_with": "is disjoint with",
    "is_related_to": "is related to", "has_broad_match": "has broad match", "has_narrow_match": "has narrow match", "has_exact_match": "has exact match",
    "has_close_match": "has close match", "has_related_match": "has related match",
}
ELSEWHERE = ["has_label", "has_preferred_label", "has_definition", "is_ordered"]


def card_anchor(uri: Column) -> Column:
    """Where a card of this view is: by its uri alone, as a node has one card here."""
    return F.concat(F.lit("id_"), F.md5(uri))


def listed(found: DataFrame) -> DataFrame:
    """id, cls of what has a card: collections and concepts by exactly these classes."""
    return found.where(F.col("cls").isin(SECTIONS["skos"])).select("id", "cls").distinct()


def definitions(values: DataFrame, language: str | None = "en") -> DataFrame:
    """id, definition: one in exactly the language, else the first by tag and value; without a language the first."""
    own = values.where(F.col("attr") == "has_definition").select("id", "attr", "v", "lang")
    return literal_pick(own, language or "").select("id", F.col("v").alias("definition"))


def concept_cards(found: DataFrame, values: DataFrame, labels: DataFrame, language: str | None = "en") -> DataFrame:
    """section, uri, anchor_id, label, definition of each collection and concept; no definition is null.

    Read a section by lower-cased label, then uri.
    """
    rows = listed(found).join(labels, "id", "left").join(definitions(values, language), "id", "left")
    return rows.select(F.col("cls").alias("section"), F.col("id").alias("uri"), card_anchor(F.col("id")).alias("anchor_id"), "label", "definition")


def semantic_sections(found: DataFrame, values: DataFrame, labels: DataFrame) -> DataFrame:
    """uri, rank, title, target, label, anchor_id, is_external: a row for each concept that a card's section lists.

    Targets that are no entities are external: their label is the local name and they have no anchor. Labels and classes
    have one row a node, so the joins don't grow; a target that very many cards list is split by Spark's skew join.
    """
    ranks = values.sparkSession.createDataFrame([(a, k, t) for k, (a, t) in enumerate(TITLES.items())], "attr string, rank int, title string")
    asked = values.where(F.col("attr").isin(list(TITLES))).join(F.broadcast(ranks), "attr").join(listed(found).select("id").distinct(), "id", "left_semi")
    known = found.select(F.col("id").alias("target"), F.lit(True).alias("inside")).distinct().join(labels.withColumnRenamed("id", "target"), "target", "left")
    rows = asked.select(F.col("id").alias("uri"), "rank", "title", F.col("v").alias("target")).distinct().join(known, "target", "left")
    inside = F.coalesce("inside", F.lit(False))
    return rows.select("uri", "rank", "title", "target", F.when(inside, F.col("label")).otherwise(local_name(F.col("target"))).alias("label"), F.when(inside, card_anchor(F.col("target"))).alias("anchor_id"), (~inside).alias("is_external"))


def attribute_title(attr: Column) -> Column:
    """``has_alternative_label`` -> ``Alternative Label``."""
    bare = F.replace(F.replace(attr, F.lit("has_"), F.lit("")), F.lit("is_"), F.lit(""))
    return F.initcap(F.translate(bare, "_", " "))


def other_relations(found: DataFrame, values: DataFrame, language: str | None = None) -> DataFrame:
    """uri, name, v, lang of all that cards have besides label, definition and sections; other languages go if one is named."""
    rest = values.where(~F.col("attr").isin([*TITLES, *ELSEWHERE])).join(listed(found).select("id").distinct(), "id", "left_semi")
    return in_language(rest.select(F.col("id").alias("uri"), attribute_title(F.col("attr")).alias("name"), "v", "lang").distinct(), language)
