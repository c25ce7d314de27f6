"""Group axioms, inherited domains and ranges, defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rules import below
from ..vocab import iri
from .closure import search
from .patterns import match
from .populate import list_values, symmetric


def pairwise(triples: DataFrame, items: DataFrame, type_: str, *predicates: str) -> DataFrame:
    """a, b: every two members of the lists of group axioms of a type, in both directions."""
    nodes = match(triples, p="rdf:type", o=type_).select(F.col("s").alias("owner")).distinct()
    return every_two(list_values(triples, items, *predicates).join(nodes, "owner", "left_semi").select("owner", "idx", "item"))


def disjoint_unions(triples: DataFrame, items: DataFrame) -> DataFrame:
    """owner, node, idx, item: each list behind owl:disjointUnionOf as a union of its own, a blank node named by owner and list."""
    node = F.concat(F.lit("_:u"), F.substring(F.sha2(F.concat_ws("\n", "owner", "head"), 256), 1, 32))
    heads = match(triples, p="owl:disjointUnionOf").select(F.col("s").alias("owner"), F.col("o").alias("head")).distinct()
    return heads.join(items, "head").select("owner", node.alias("node"), "idx", "item")


def every_two(members: DataFrame) -> DataFrame:
    """a, b: every two members (owner, idx, item) of an owner, in both directions."""
    other = members.select("owner", F.col("idx").alias("j"), F.col("item").alias("b"))
    one = members.join(other, "owner").where("idx < j and item <> b").select(F.col("item").alias("a"), "b")
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _declared(triples: DataFrame) -> DataFrame:
    """id, side, value with IRI values only."""
    side = F.when(F.col("p") == iri("rdfs:domain"), "domain").otherwise("range")
    return triples.where(F.col("p").isin(iri("rdfs:domain"), iri("rdfs:range")) & (F.col("o_kind") == "iri")).select(F.col("s").alias("id"), side.alias("side"), F.col("o").alias("value")).distinct()


def domains_and_ranges(triples: DataFrame, properties: DataFrame, dialect: str = "owl", classes: DataFrame | None = None) -> DataFrame:
    """prop, side, value, source for the (id, cls) ``properties``.

    A declared side stays. Otherwise, for relations, the opposite side of an inverse (other than owl:Thing)
    counts, then the nearest ancestor's own side or its inverses' opposite side, at equal depth the smallest
    IRI; attributes take the nearest ancestor's own side. What is left gets the dialect's default:
    owl:Thing, for ranges of attributes rdfs:Literal; in RDF rdfs:Resource and rdfs:Class. Annotations have
    no default. With the ``classes`` (id, cls) of values, an inferred range stays only if it is a datatype, for
    attributes, or any concept, for relations.
    """
    declared = _declared(triples)
    sides = properties.withColumn("side", F.explode(F.array(F.lit("domain"), F.lit("range"))))
    opposite = F.when(F.col("side") == "domain", "range").otherwise("domain")
    inverse = symmetric(triples, "owl:inverseOf").select(F.col("a").alias("id"), F.col("b"))
    swapped = declared.select(F.col("id").alias("b"), opposite.alias("side"), "value").where(F.col("value") != iri("owl:Thing"))
    by_inverse = inverse.join(swapped, "b").groupBy("id", "side").agg(F.min("value").alias("value")).withColumn("source", F.lit("inverse"))
    above_of = match(triples, p="rdfs:subPropertyOf").select(F.col("s").alias("a"), F.col("o").alias("b"))
    own = declared.groupBy("id", "side").agg(F.min("value").alias("value"))
    above = own.unionByName(by_inverse.drop("source").join(own.select("id", "side"), ["id", "side"], "left_anti"))
    relation = properties.where("cls <> 'Attribute'").select("id").distinct()
    attribute = properties.where("cls = 'Attribute'").select("id").distinct()
    undeclared = sides.select("id", "side").distinct().join(declared.select("id", "side"), ["id", "side"], "left_anti")

    def up(of: DataFrame, marked: DataFrame) -> DataFrame:
        found = search(above_of, of, marked, "value", key=["side"])
        return found.select("id", "side", "value", F.lit("ancestor").alias("source"))

    if dialect == "owl":
        for_attributes = up(undeclared.join(attribute, "id", "left_semi"), own)
        for_relations = by_inverse.unionByName(up(undeclared.join(relation, "id", "left_semi").join(by_inverse, ["id", "side"], "left_anti"), above))
    else:
        for_attributes = for_relations = up(undeclared, own)
    found = for_relations.join(relation, "id", "left_semi").unionByName(for_attributes.join(attribute, "id", "left_semi"))
    best = found.groupBy("id", "side").agg(F.min(F.struct(F.when(F.col("source") == "inverse", 0).otherwise(1).alias("k"), "value", "source")).alias("m"))
    if classes is not None:
        data = F.max(F.col("cls").isin(*below("Datatype"), *below("DatatypeRestriction"))).alias("is_data")
        fits = classes.where(F.col("cls").isin(below("Concept"))).groupBy(F.col("id").alias("fit")).agg(data)
        kinds = properties.groupBy("id").agg(F.max(F.col("cls") == "Attribute").alias("is_attribute"))
        checked = best.join(kinds, "id").join(fits, F.col("m.value") == F.col("fit"), "left")
        best = checked.where("side = 'domain' or (fit is not null and (is_data or not is_attribute))").select("id", "side", "m")
    if dialect == "owl":
        default = F.when((F.col("cls") == "Attribute") & (F.col("side") == "range"), iri("rdfs:Literal")).when(F.col("cls").isin("Relation", "Attribute"), iri("owl:Thing"))
    else:
        default = F.when(F.col("side") == "domain", iri("rdfs:Resource")).otherwise(iri("rdfs:Class"))
    missing = sides.join(declared.select("id", "side").distinct(), ["id", "side"], "left_anti").join(best, ["id", "side"], "left")
    inferred = missing.select(F.col("id").alias("prop"), "side", F.coalesce("m.value", default).alias("value"), F.coalesce("m.source", F.lit("default")).alias("source")).where("value is not null")
    kept = declared.join(properties.select("id"), "id", "left_semi").select(F.col("id").alias("prop"), "side", "value", F.lit("declared").alias("source"))
    return kept.unionByName(inferred)


def typed_properties(triples: DataFrame) -> DataFrame:
    """id, cls of properties by their declared OWL types; a relation wins over an attribute."""
    kinds = {iri("owl:ObjectProperty"): (0, "Relation"), iri("owl:DatatypeProperty"): (1, "Attribute"), iri("owl:AnnotationProperty"): (2, "Annotation")}
    rank = F.try_element_at(F.create_map(*[x for k, (n, _) in kinds.items() for x in (F.lit(k), F.lit(n))]), F.col("o"))
    best = match(triples, p="rdf:type").where(F.col("o").isin(list(kinds))).groupBy(F.col("s").alias("id")).agg(F.min(rank).alias("k"))
    return best.select("id", F.when(F.col("k") == 0, "Relation").when(F.col("k") == 1, "Attribute").otherwise("Annotation").alias("cls"))


def default_types(triples: DataFrame, individuals: DataFrame) -> DataFrame:
    """id, type: owl:Thing for individuals (id) that no other type is known of."""
    from .populate import types

    return individuals.select("id").distinct().join(types(triples).select("id"), "id", "left_anti").withColumn("type", F.lit(iri("owl:Thing")))
