"""Warnings about an ontology: code, subject, message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import local_name
from ..rules import lattice_frame, predicate_rules, below
from ..vocab import iri
from .patterns import match, with_predicates
from .populate import CARDINALITIES, truth_functions
from .retract import unresolved

FILLERS = ["owl:someValuesFrom", "owl:allValuesFrom", *CARDINALITIES]


def _row(df: DataFrame, code: str, subject, message) -> DataFrame:
    return df.select(F.lit(code).alias("code"), subject.alias("subject"), message.alias("message")).distinct()


def malformed_restrictions(triples: DataFrame) -> DataFrame:
    """Blank nodes with several quantifier or cardinality predicates, by their smallest IRI parent."""
    kinds = with_predicates(triples, *FILLERS).where("s_kind = 'bnode'").select("s", "p").distinct()
    several = kinds.groupBy("s").agg(F.count("*").alias("n")).where("n > 1").select("s")
    parents = triples.where("s_kind = 'iri' and o_kind = 'bnode'").groupBy(F.col("o").alias("s")).agg(F.min("s").alias("parent"))
    named = kinds.join(several, "s").join(parents, "s", "left").withColumn("subject", F.coalesce("parent", F.lit("<anonymous>")))
    per = named.groupBy("subject").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("owl:"), local_name(F.col("p"))))), ", ").alias("names"))
    return _row(per, "malformed_restriction", F.col("subject"), F.concat(F.lit("OWL 2 DL: malformed restrictions on "), "subject", F.lit(" ("), "names", F.lit(")")))


def small_truth_functions(triples: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """Intersections and unions with no member (n = 0) or one (n = 1)."""
    found = truth_functions(triples, items).where(F.col("operator") != "not").where(F.col("n") == n)
    code, tail = ("empty_truth_function", ") is empty — ignored (collection BNode: ") if n == 0 else ("singleton_truth_function", ") has a single element — ontology should be checked (collection BNode: ")
    start = "§8.1.1: Truth Function (" if n == 0 else "§8.1.1: TruthFunction ("
    return _row(found, code, F.col("id"), F.concat(F.lit(start), "id", F.lit(", "), "operator", F.lit(tail), "id", F.lit(")")))


def empty_restrictions(triples: DataFrame, items: DataFrame) -> DataFrame:
    found = truth_functions(triples, items).where("n = 0")
    return _row(found, "empty_restriction", F.col("id"), F.lit("TruthFunction has empty applies_on_concept"))


def orphan_restrictions(triples: DataFrame) -> DataFrame:
    """Quantifiers and cardinalities without owl:onProperty."""
    kind = F.when(F.max(F.col("p").isin(iri("owl:someValuesFrom"), iri("owl:allValuesFrom"))), "Quantifier").otherwise("Cardinality")
    found = with_predicates(triples, *FILLERS).where("s_kind = 'bnode'").groupBy("s").agg(kind.alias("kind"))
    orphans = found.join(match(triples, p="owl:onProperty").select("s"), "s", "left_anti")
    return _row(orphans, "orphan_restriction", F.col("s"), F.concat(F.lit("Orphan "), "kind", F.lit(": no owl:onProperty in graph, removed")))


def missing_properties(triples: DataFrame, found: DataFrame) -> DataFrame:
    """Quantifiers and cardinalities that stay, though no property could be made of their owl:onProperty."""
    return _row(unresolved(triples, found), "missing_on_property", F.col("id"), F.concat("cls", F.lit(" has owl:onProperty but applies_on_property is None")))


def multiple_inverses(triples: DataFrame) -> DataFrame:
    pairs = match(triples, p="owl:inverseOf").where("s_kind = 'iri' and o_kind = 'iri'").select(F.col("s").alias("a"), F.col("o").alias("b"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    per = both.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("ids")).where(F.size("ids") > 1)
    return _row(per, "multiple_inverse_of", F.col("a"), F.concat(F.lit("§9.2.4: Relation "), "a", F.lit(" has "), F.size("ids").cast("string"), F.lit(" owl:inverseOf declarations ("), F.array_join("ids", ", "), F.lit(")")))


def hierarchy_mismatches(triples: DataFrame, found: DataFrame, p: str, code: str, classes: list[str]) -> DataFrame:
    """Children of one of the ``classes`` whose parent's class isn't the same or a subclass of it."""
    kinds = found.where(F.col("cls").isin(classes)).select("id", "cls")
    edges = match(triples, p=p).where("s_kind = 'iri' and o_kind = 'iri'").select("s", "o").distinct()
    sides = edges.join(kinds.select(F.col("id").alias("s"), F.col("cls").alias("child")), "s").join(kinds.select(F.col("id").alias("o"), F.col("cls").alias("parent")), "o")
    fine = F.broadcast(lattice_frame(triples.sparkSession).select(F.col("sub").alias("parent"), F.col("sup").alias("child")))
    bad = sides.join(fine, ["parent", "child"], "left_anti")
    name = "subPropertyOf" if p == "rdfs:subPropertyOf" else "subClassOf"
    return _row(bad, code, F.col("s"), F.concat(F.lit("§5.8.1: "), "child", F.lit(" "), "s", F.lit(f" {name} "), "parent", F.lit(" "), "o"))


def property_hierarchy(triples: DataFrame, found: DataFrame) -> DataFrame:
    return hierarchy_mismatches(triples, found, "rdfs:subPropertyOf", "property_type_mismatch_hierarchy", ["Relation", "Attribute", "Annotation"])


def class_hierarchy(triples: DataFrame, found: DataFrame) -> DataFrame:
    return hierarchy_mismatches(triples, found, "rdfs:subClassOf", "class_datatype_mismatch_hierarchy", ["Concept", "Datatype"])


def punning_conflicts(found: DataFrame) -> DataFrame:
    """IRIs that are class and datatype at once, or several kinds of property."""
    per = found.where("id_kind = 'iri'").groupBy("id").agg(F.array_sort(F.collect_set("cls")).alias("all"))
    data = _row(per.where(F.array_contains("all", "Concept") & F.array_contains("all", "Datatype")), "class_datatype_conflict", F.col("id"), F.concat(F.lit("§5.8.1: "), "id", F.lit(" has both Concept and Datatype in cache")))
    several = per.withColumn("props", F.array_intersect("all", F.array(*map(F.lit, ("Annotation", "Attribute", "Relation"))))).where(F.size("props") > 1)
    props = _row(several, "property_type_conflict", F.col("id"), F.concat(F.lit("§5.8.1: "), "id", F.lit(" has multiple property types: ['"), F.array_join("props", "', '"), F.lit("']")))
    return data.unionByName(props)


def config_mismatches(triples: DataFrame, found: DataFrame, dialect: str = "owl") -> DataFrame:
    """IRI subjects of a mapped predicate none of whose classes is a target of its rule."""
    spark = triples.sparkSession
    rows = [(r.name, "['" + "', '".join(r.targets) + "']", sorted({c for t in r.targets for c in below(t)})) for r in predicate_rules(dialect) if r.targets]
    targets = spark.createDataFrame(rows, "p string, expected string, fine array<string>")
    uses = triples.where("s_kind = 'iri'").select("s", "p").distinct().join(F.broadcast(targets), "p")
    per = found.groupBy(F.col("id").alias("s")).agg(F.array_sort(F.collect_set("cls")).alias("all"))
    bad = uses.join(per, "s").where(~F.arrays_overlap("fine", "all"))
    return _row(bad, "config_type_mismatch", F.col("s"), F.concat("s", F.lit(" subject of "), "p", F.lit(" (expected "), "expected", F.lit(") got ['"), F.array_join("all", "', '"), F.lit("']")))


def all_warnings(triples: DataFrame, items: DataFrame, found: DataFrame, dialect: str = "owl") -> DataFrame:
    parts = [malformed_restrictions(triples), small_truth_functions(triples, items, 0), small_truth_functions(triples, items, 1), orphan_restrictions(triples), missing_properties(triples, found), multiple_inverses(triples), empty_restrictions(triples, items), property_hierarchy(triples, found), class_hierarchy(triples, found), punning_conflicts(found), config_mismatches(triples, found, dialect)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def has_warning(warnings: DataFrame, code: str, subject: str | None = None) -> bool:
    hits = warnings.where(F.col("code") == code)
    return not (hits if subject is None else hits.where(F.col("subject") == subject)).isEmpty()




def write_warnings(warnings: DataFrame, path: str) -> None:
    """One JSON object a line: code, subject, message."""
    warnings.write.mode("overwrite").json(path)
