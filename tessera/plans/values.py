"""The table of values: what every mapped predicate, type and group axiom fills in, in long form.

``id, attr, ord, v, lang``; ``ord`` is the position in a list, else 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..operators import axioms, classify, populate, retract, statements
from ..operators.closure import materialize
from ..operators.patterns import match
from ..vocab import iri

#: Lists whose items are values of the list's owner.
LISTED = {"owl:hasKey": "has_key", "owl:propertyChainAxiom": "has_property_chain", "owl:oneOf": "applies_on_resource"}


def _rows(df: DataFrame, attr: str | Column, id: str = "id", v: str | Column = "v", ord: str | int = 0, lang: str | None = None) -> DataFrame:
    return df.select(
        F.col(id).alias("id"), (F.lit(attr) if isinstance(attr, str) else attr).alias("attr"),
        (F.lit(ord) if isinstance(ord, int) else F.col(ord)).cast("int").alias("ord"),
        (F.col(v) if isinstance(v, str) else v).cast("string").alias("v"), (F.col(lang) if lang else F.lit("")).alias("lang"),
    ).where("v is not null")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def setters(triples: DataFrame, dialect: str) -> DataFrame:
    """What rules without a handler set, and the constants that types set: one join with the rules."""
    is_type = F.col("p") == iri("rdf:type")
    keyed = triples.select("s", "o", is_type.alias("is_type"), F.when(is_type, F.col("o")).otherwise(F.col("p")).alias("name"))
    table = rules.setter_frame(triples.sparkSession, dialect)
    return _rows(keyed.join(F.broadcast(table), ["is_type", "name"]), F.col("attr"), "s", F.coalesce("constant", "o"))


def scoped(triples: DataFrame, found: DataFrame, dialect: str = "owl") -> DataFrame:
    """The triples that values come from: those that fill in one of the entities ``found``, types, and the inner nodes of
    lists, facets and inline inverses, which are no entities. What is left of an entity's triples are its statements."""
    types = F.col("p") == iri("rdf:type")
    nodes = statements.structured_nodes(triples, found, dialect).select(F.col("id").alias("s"))
    inner = triples.where(~types).where("s_kind = 'bnode'").where(~statements.is_cell()).join(nodes, "s", "left_semi")
    filling = statements.filling(triples, found, dialect).where(~types)
    return triples.where(types).unionByName(filling).unionByName(inner.select(*triples.columns))


def asserted(triples: DataFrame, items: DataFrame, dialect: str = "owl") -> DataFrame:
    """Values that follow from ``scoped`` triples and lists alone; group axioms give every two of their members."""
    return _asserted(triples, items, dialect).distinct()


def _asserted(triples: DataFrame, items: DataFrame, dialect: str) -> DataFrame:
    types = populate.type_links(triples)
    parts = [
        _rows(populate.literals(triples, dialect), F.col("attr"), lang="lang"),
        _rows(types, "has_type", v="type"),
        _rows(types, "individuals_with_this_type", "type", "id"),
        setters(triples, dialect),
    ]
    for r in rules.predicate_rules(dialect):
        if r.handler and r.handler.startswith("symmetric:"):
            parts.append(_rows(populate.symmetric(triples, r.name), r.handler.split(":")[1], "a", "b"))
        if r.handler == "narrower":
            parts.append(_rows(match(triples, p=r.name).where("o_kind <> 'literal'"), "is_sub_concept_of", "o", "s"))
    parts.append(_rows(populate.containers(triples), "has_member", "container", "member", "pos"))
    return _union(parts + (_axioms(triples, items) if dialect == "owl" else []))


def _axioms(triples: DataFrame, items: DataFrame) -> list[DataFrame]:
    listed = populate.list_values(triples, items, *LISTED)
    attr = F.create_map(*[F.lit(x) for p, a in LISTED.items() for x in (iri(p), a)])[F.col("p")]
    on_property = populate.on_property(triples)
    counted, valued = populate.cardinalities(triples), populate.has_values(triples)
    facets, unions = populate.facets(triples, items), axioms.disjoint_unions(triples, items)
    atoms = populate.swrl_rules(triples, items)
    side = F.when(F.col("side") == "body", "has_antecedent").otherwise("has_consequent")
    out = [
        _rows(listed, attr, "owner", "item", "idx"),
        _rows(on_property, "applies_on_property", "restriction", "property"),
        _rows(on_property.where("is_inverse"), "is_inverse", "restriction", F.lit("True")),
        _rows(counted, "has_cardinality_type", v="kind"),
        _rows(counted, "has_cardinality", v="n"),
        _rows(counted, "applies_on_concept", v="filler"),
        _rows(valued, "applies_on_resource"),
        _rows(facets, "has_facet", v="comparator", ord="idx"),
        _rows(facets, "has_restriction_value", ord="idx"),
        _rows(facets, "applies_on_concept", v="datatype"),
        _rows(unions, "is_equivalent_to", "owner", "node"),
        _rows(unions, "has_logical_operator", "node", F.lit("or")),
        _rows(unions, "applies_on_concept", "node", "item", "idx"),
        _rows(axioms.every_two(unions.select(F.col("node").alias("owner"), "idx", "item")), "is_disjoint_with", "a", "b"),
        _rows(atoms, side, "rule", "atom", "pos"),
        _rows(atoms, "has_predicate", "atom", "predicate"),
        _rows(populate.atom_arguments(triples, items), "has_arguments", v="arg", ord="pos"),
    ]
    for type_, name in rules.ENRICHERS.items():
        if name.startswith("is_"):
            members = "owl:distinctMembers" if type_ == "owl:AllDifferent" else "owl:members"
            out.append(_rows(axioms.pairwise(triples, items, type_, members), name, "a", "b"))
    return out


def of_lists(made: DataFrame, items: DataFrame) -> DataFrame:
    """The members of lists that statements have as objects."""
    return _rows(statements.list_objects(made, items), "has_member", ord="idx", v="item")


def stated(triples: DataFrame, items: DataFrame, found: DataFrame, dialect: str = "owl", gone: DataFrame | None = None) -> DataFrame:
    """What the triples state about the entities ``found``, truth functions included, without what is taken back."""
    out = _asserted(materialize(scoped(triples, found, dialect)), items, dialect)
    if dialect != "owl":
        return out.distinct()
    gone = retract.retracted(triples, items, found) if gone is None else gone
    truths = retract.truth_values(triples, items, found, gone).withColumn("lang", F.lit(""))
    return retract.kept(out.unionByName(truths), gone).distinct()


def of_entities(triples: DataFrame, entities: DataFrame, dialect: str = "owl") -> DataFrame:
    """Values that also depend on the classes of nodes: domains and ranges, default types, several classes of one node."""
    parts = []
    if dialect in ("owl", "rdf"):
        kinds = entities.where(F.col("cls").isin("Relation", "Attribute", "Annotation") if dialect == "owl" else F.col("cls") == "Property").select("id", "cls")
        sides = axioms.domains_and_ranges(triples, kinds, dialect, entities if dialect == "owl" else None)
        parts.append(_rows(sides, F.concat(F.lit("has_"), "side"), "prop", "value"))
    if dialect == "owl":
        parts.append(_rows(axioms.default_types(triples, entities.where("cls = 'Individual'")), "has_type", v="type"))
    several = classify.punned(entities).select("id", F.explode(F.split("others", ",")).alias("v"))
    parts.append(_rows(several, "also_defined_as"))
    return _union(parts).distinct()
