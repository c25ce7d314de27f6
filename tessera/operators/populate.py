"""What the mapped predicates fill in: literals, types, symmetric axioms, restrictions, lists, containers, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rules import predicate_rules
from ..vocab import FACETS, PREFIXES, iri
from .patterns import match, not_structural, value, with_predicates


def _map(pairs: dict[str, str], key):
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def literals(triples: DataFrame, dialect: str = "owl") -> DataFrame:
    """id, attr, v, lang of all attributes that take literals; an IRI there fills nothing in."""
    attributes = {r.name: a for r in predicate_rules(dialect) for a, kind in r.setters.items() if kind == "Literal"}
    return triples.where(F.col("p").isin(list(attributes)) & (F.col("o_kind") == "literal")).select(F.col("s").alias("id"), _map(attributes, F.col("p")).alias("attr"), F.col("o").alias("v"), F.col("o_lang").alias("lang")).distinct()


def types(triples: DataFrame) -> DataFrame:
    """id, type: rdf:type without structural terms other than owl:Thing, owl:Nothing and rdfs:Literal."""
    return type_links(triples).distinct()


def type_links(triples: DataFrame) -> DataFrame:
    """``types``, as often as the triples have them."""
    kept = not_structural("o") | F.col("o").isin(iri("owl:Thing"), iri("owl:Nothing"), iri("rdfs:Literal"))
    return match(triples, p="rdf:type").where(kept).select(F.col("s").alias("id"), F.col("o").alias("type"))


def individuals_by_type(triples: DataFrame) -> DataFrame:
    """type, n: the inverse of ``types``, counted."""
    return types(triples).groupBy("type").agg(F.count("*").alias("n"))


def symmetric(triples: DataFrame, p: str) -> DataFrame:
    """a, b in both directions of a symmetric axiom."""
    one = match(triples, p=p).where("o_kind <> 'literal'").select(F.col("s").alias("a"), F.col("o").alias("b"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()


def on_property(triples: DataFrame) -> DataFrame:
    """restriction, property, is_inverse: inline inverses are resolved to the property behind them."""
    inverse = match(triples, p="owl:inverseOf").where("s_kind = 'bnode'").groupBy(F.col("s").alias("o")).agg(F.min("o").alias("of"))
    return match(triples, p="owl:onProperty").select(F.col("s").alias("restriction"), "o").join(inverse, "o", "left").select("restriction", F.coalesce("of", "o").alias("property"), F.col("of").isNotNull().alias("is_inverse"))


def list_values(triples: DataFrame, items: DataFrame, *predicates: str) -> DataFrame:
    """owner, p, idx, item, item_kind of the lists behind the given predicates."""
    owners = with_predicates(triples, *predicates).select(F.col("s").alias("owner"), "p", F.col("o").alias("head"))
    return owners.join(items, "head").select("owner", "p", "idx", "item", "item_kind")


def facets(triples: DataFrame, items: DataFrame) -> DataFrame:
    """id, idx, comparator, v, datatype of datatype restrictions."""
    nodes = list_values(triples, items, "owl:withRestrictions").select(F.col("owner").alias("id"), "idx", F.col("item").alias("s"))
    values = triples.where(F.col("p").isin([iri(f) for f in FACETS])).select("s", _map({iri(k): c for k, c in FACETS.items()}, F.col("p")).alias("comparator"), F.col("o").alias("v"))
    base = value(triples, "owl:onDatatype").select(F.col("s").alias("id"), F.col("o").alias("datatype"))
    return nodes.join(values, "s").join(base, "id", "left").select("id", "idx", "comparator", "v", "datatype")


CARDINALITIES = {"owl:cardinality": "exactly", "owl:qualifiedCardinality": "exactly", "owl:minCardinality": "min", "owl:minQualifiedCardinality": "min", "owl:maxCardinality": "max", "owl:maxQualifiedCardinality": "max"}


def cardinalities(triples: DataFrame) -> DataFrame:
    """id, kind, n, property, filler (the class or data range, else owl:Thing)."""
    found = with_predicates(triples, *CARDINALITIES).groupBy(F.col("s").alias("id")).agg(F.min(F.struct(_map({iri(k): v for k, v in CARDINALITIES.items()}, F.col("p")).alias("kind"), F.expr("try_cast(o as int)").alias("n"))).alias("c"))
    filler = lambda p, name: value(triples, p).select(F.col("s").alias("id"), F.col("o").alias(name))
    full = found.join(_property_of(triples), "id", "left").join(filler("owl:onClass", "c1"), "id", "left").join(filler("owl:onDataRange", "c2"), "id", "left")
    return full.select("id", "c.kind", "c.n", "property", F.coalesce("c1", "c2", F.lit(iri("owl:Thing"))).alias("filler"))


def _property_of(triples: DataFrame) -> DataFrame:
    return on_property(triples).groupBy(F.col("restriction").alias("id")).agg(F.min("property").alias("property"))


def quantifiers(triples: DataFrame) -> DataFrame:
    """id, quantifier (some or only), property, filler."""
    found = with_predicates(triples, "owl:someValuesFrom", "owl:allValuesFrom").select(F.col("s").alias("id"), F.when(F.col("p") == iri("owl:someValuesFrom"), "some").otherwise("only").alias("quantifier"), F.col("o").alias("filler"))
    return found.join(_property_of(triples), "id", "left").select("id", "quantifier", "property", "filler")


def has_values(triples: DataFrame) -> DataFrame:
    """id, property, v."""
    return match(triples, p="owl:hasValue").select(F.col("s").alias("id"), F.col("o").alias("v")).join(_property_of(triples), "id", "left").select("id", "property", "v")


def truth_functions(triples: DataFrame, items: DataFrame) -> DataFrame:
    """id, operator, n, members (by position, comma-separated) of intersections, unions and complements."""
    boolean = with_predicates(triples, "owl:intersectionOf", "owl:unionOf").select(F.col("s").alias("id"), F.when(F.col("p") == iri("owl:intersectionOf"), "and").otherwise("or").alias("operator"), F.col("o").alias("head"))
    listed = boolean.join(items, "head", "left").groupBy("id", "operator").agg(F.count("item").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("item").isNotNull(), F.struct("idx", "item")))), lambda x: x["item"]), ",").alias("members"))
    negated = match(triples, p="owl:complementOf").select(F.col("s").alias("id"), F.lit("not").alias("operator"), F.lit(1).cast("long").alias("n"), F.col("o").alias("members"))
    return listed.unionByName(negated)


def memberships(triples: DataFrame) -> DataFrame:
    """The triples that give an rdf:Bag, rdf:Alt or rdf:Seq its members."""
    kinds = match(triples, p="rdf:type").where(F.col("o").isin([iri("rdf:Bag"), iri("rdf:Alt"), iri("rdf:Seq")])).select("s").distinct()
    return triples.where(F.col("p").startswith(iri("rdf:_")) & (F.regexp_extract("p", "_(\\d+)$", 1) != "")).join(kinds, "s", "left_semi").select(*triples.columns)


def containers(triples: DataFrame) -> DataFrame:
    """container, pos, member of rdf:Bag, rdf:Alt and rdf:Seq; positions are numbers, so 10 comes after 2."""
    # Where a scan has one predicate Spark evaluates the cast while it plans, before the rows are filtered.
    return memberships(triples).select(F.col("s").alias("container"), F.regexp_extract("p", "_(\\d+)$", 1).try_cast("long").alias("pos"), F.col("o").alias("member"))


def collections(triples: DataFrame, items: DataFrame, dialect: str = "owl") -> DataFrame:
    """owner, p, idx, item of the lists behind predicates that no rule knows, whatever they are: an object is a list if it
    is the first node of one."""
    known = [r.name for r in predicate_rules(dialect)]
    heads = triples.where(~F.col("p").isin([*known, iri("rdf:rest"), iri("rdf:first")]) & (F.col("o_kind") != "literal")).select(F.col("s").alias("owner"), "p", F.col("o").alias("head"))
    return heads.join(items, "head").select("owner", "p", "idx", "item")


def swrl_rules(triples: DataFrame, items: DataFrame) -> DataFrame:
    """rule, side, pos, atom, predicate, args of the atoms of SWRL rules."""
    sides = list_values(triples, items, "swrl:body", "swrl:head").select(F.col("owner").alias("rule"), F.regexp_extract("p", "#(.*)$", 1).alias("side"), F.col("idx").alias("pos"), F.col("item").alias("id"))
    predicate = with_predicates(triples, "swrl:classPredicate", "swrl:propertyPredicate", "swrl:builtin", "swrl:dataRange").groupBy(F.col("s").alias("id")).agg(F.min("o").alias("predicate"))
    arguments = atom_arguments(triples, items).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("pos", "arg"))), lambda x: x["arg"]), ",").alias("args"))
    kinds = with_predicates(triples, "rdf:type").groupBy(F.col("s").alias("id")).agg(F.min("o").alias("kind"))
    # Atoms about identity have no predicate of their own.
    implied = F.when(F.col("kind").startswith(PREFIXES["swrl"] + "SameIndividual"), iri("owl:sameAs")).when(F.col("kind") == iri("swrl:DifferentIndividualsAtom"), iri("owl:differentFrom"))
    return sides.join(predicate, "id", "left").join(arguments, "id", "left").join(kinds, "id", "left").select("rule", "side", "pos", F.col("id").alias("atom"), F.coalesce("predicate", implied).alias("predicate"), "args")


def atom_arguments(triples: DataFrame, items: DataFrame) -> DataFrame:
    """id, pos, arg: first and second argument of an atom, then those of its list."""
    two = with_predicates(triples, "swrl:argument1", "swrl:argument2").select(F.col("s").alias("id"), F.when(F.col("p") == iri("swrl:argument1"), 1).otherwise(2).cast("long").alias("pos"), F.col("o").alias("arg"))
    listed = list_values(triples, items, "swrl:arguments").select(F.col("owner").alias("id"), (F.col("idx") + 2).cast("long").alias("pos"), F.col("item").alias("arg"))
    return two.unionByName(listed)
