"""Which entity classes each node has: rules by predicate and by type, identity, punning, property types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import OWN, PUNNING_PRIORITY, RANGE, below, lattice, predicate_frame, predicate_rules, request_frame, type_frame, type_rules
from ..vocab import BUILTIN_DATATYPES, PREFIXES, iri
from .closure import materialize, search
from .patterns import match, not_structural


def _below(a: Column, b: Column) -> Column:
    """``a`` is ``b`` or a subclass of it."""
    pairs = F.create_map(*[x for name, up in lattice().items() for x in (F.lit(name), F.array(*map(F.lit, up)))])
    return F.coalesce(F.array_contains(F.try_element_at(pairs, a), b), F.lit(False))


def classify_by_predicate(triples: DataFrame, dialect: str = "owl") -> DataFrame:
    """id, id_kind, cls: what the predicates of a subject make of it.

    Rules go in merged order: of inferred classes the first stays unless a later one is below it; without
    any, the first rule with a single target decides.
    """
    rules = predicate_frame(triples.sparkSession, dialect).where("inferred is not null or single is not null")
    found = triples.join(F.broadcast(rules), "p").select(F.col("s").alias("id"), F.col("s_kind").alias("id_kind"), "ord", "inferred", "single")
    return _by_predicates(found, ["id", "id_kind"])


def _by_predicates(found: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, cls: the fold over the rules (ord, inferred, single) that the predicates of each meet."""
    per = found.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("ord", "inferred"))).alias("r"), F.min(F.when(F.col("single").isNotNull(), F.struct("ord", "single"))).alias("one"))
    folded = F.aggregate("r", F.lit(None).cast("string"), lambda acc, x: F.when(x["inferred"].isNull(), acc).when(acc.isNull() | _below(x["inferred"], acc), x["inferred"]).otherwise(acc))
    return per.select(*keys, F.coalesce(folded, F.col("one.single")).alias("cls")).where("cls is not null")


def predicate_requests(triples: DataFrame, dialect: str = "owl") -> DataFrame:
    """Phase 1: classes by predicate, without blank nodes behind owl:onProperty and IRIs that would be restrictions."""
    found = classify_by_predicate(triples, dialect)
    if dialect != "owl":
        return found
    inline = match(triples, p="owl:onProperty").select(F.col("o").alias("id")).distinct()
    return found.where(~((F.col("id_kind") == "iri") & F.col("cls").isin(below("Restriction")))).join(inline.withColumn("id_kind", F.lit("bnode")), ["id", "id_kind"], "left_anti")


def type_requests(triples: DataFrame, dialect: str = "owl") -> DataFrame:
    """Phase 2: id, id_kind, ord, cls by rdf:type."""
    return match(triples, p="rdf:type").join(F.broadcast(type_frame(triples.sparkSession, dialect)), "o").select(F.col("s").alias("id"), F.col("s_kind").alias("id_kind"), "ord", "cls").distinct()


def created_from_types(triples: DataFrame, dialect: str = "owl") -> DataFrame:
    """id, cls of phase 2 alone: classes of mapped types, and Individual for IRIs whose types are all unmapped."""
    mapped = type_requests(triples, dialect).select("id", "cls").distinct()
    rest = match(triples, p="rdf:type").where("s_kind = 'iri'").select(F.col("s").alias("id")).distinct().join(mapped, "id", "left_anti")
    return mapped.unionByName(rest.withColumn("cls", F.lit("Individual")))


#: Rules that one number has as bits.
WORD = 62


def _masks(dialect: str) -> tuple[dict[str, int], dict[str, int], list[tuple], tuple[int, int, int]]:
    """Rules as bits: of a predicate, of a type, (bit, phase, ord, inferred, cls) of each rule that gives a class, and the bits of
    any type, of owl:NamedIndividual and of what stands behind owl:onProperty."""
    by_p, by_o, rows = {}, {}, []
    for r in predicate_rules(dialect):
        single = r.targets[0] if len(r.targets) == 1 else None
        if r.inferred or single:
            by_p[r.name] = by_p.get(r.name, 0) | 1 << len(rows)
            rows.append((len(rows), 1, r.ord, r.inferred, single))
    for r in type_rules(dialect):
        by_o[r.name] = by_o.get(r.name, 0) | 1 << len(rows)
        rows.append((len(rows), 2, r.ord, None, r.targets[0]))
    typed, named, inline = (1 << len(rows) + k for k in range(3))
    by_p[iri("rdf:type")] = by_p.get(iri("rdf:type"), 0) | typed
    by_o[iri("owl:NamedIndividual")] = by_o.get(iri("owl:NamedIndividual"), 0) | named
    return by_p, by_o, rows, (typed, named, inline)


def _words(mask: int, n: int) -> list[int]:
    return [mask >> WORD * k & (1 << WORD) - 1 for k in range(n)]


def _rules_met(triples: DataFrame, dialect: str, more: DataFrame | None, words: list[str]) -> DataFrame:
    """id, id_kind, is_builtin, ``words`` (and ``later``, of ``more``): which rules each node meets, one row a node."""
    spark, n = triples.sparkSession, len(words)
    by_p, by_o, _, (_, _, inline) = _masks(dialect)
    frame = lambda masks, key, names: F.broadcast(spark.createDataFrame([(k, *_words(m, n)) for k, m in masks.items()], f"{key} string, " + ", ".join(f"{x} long" for x in names)))
    of_p, of_o = [f"{w}_p" for w in words], [f"{w}_o" for w in words]
    is_type = F.col("p") == iri("rdf:type")
    met = triples.join(frame(by_p, "p", of_p), "p").withColumn("o", F.when(is_type, F.col("o"))).join(frame(by_o, "o", of_o), "o", "left")
    rows = met.select(F.col("s").alias("id"), F.col("s_kind").alias("id_kind"), *[F.col(a).bitwiseOR(F.coalesce(b, F.lit(0).cast("long"))).alias(w) for w, a, b in zip(words, of_p, of_o)])
    if dialect == "owl":
        rows = rows.unionByName(match(triples, p="owl:onProperty").select(F.col("o").alias("id"), F.lit("bnode").alias("id_kind"), *[F.lit(x).cast("long").alias(w) for w, x in zip(words, _words(inline, n))]))
    folded = [F.bit_or(w).alias(w) for w in words]
    if more is not None:
        rows = rows.withColumn("later", F.lit(None).cast("struct<phase:int,ord:int,cls:string>"))
        rows = rows.unionByName(more.select("id", "id_kind", *[F.lit(0).cast("long").alias(w) for w in words], F.struct("phase", "ord", "cls").alias("later")))
        folded.append(F.array_sort(F.collect_set("later")).alias("later"))
    builtin = F.col("id").startswith(PREFIXES["xsd"]) | F.col("id").isin([iri(c) for c in BUILTIN_DATATYPES])
    return rows.groupBy("id", "id_kind").agg(*folded).withColumn("is_builtin", builtin & (F.col("id_kind") == "iri"))


def _resolved(sets: DataFrame, dialect: str, words: list[str]) -> DataFrame:
    """``sets`` (id_kind, is_builtin, words, later) with ``cls``, a row for each class that nodes with such a set have.

    Requests go in the order of phases and rules. Phase 1 is ``predicate_requests``, phase 2 ``type_requests``; IRIs with types
    that give neither are Individuals. A request below the only class so far promotes it; one above a class changes
    nothing; any other adds a class. Blank nodes keep their first class; Individual adds nothing to a node that has a class
    unless it is an owl:NamedIndividual; XSD and built-in datatypes are Datatypes.
    """
    spark, keys = sets.sparkSession, sets.columns
    _, _, rows, (typed, named, inline) = _masks(dialect)
    has = lambda mask: reduce(Column.__or__, [F.col(w).bitwiseAND(F.lit(x).cast("long")) != 0 for w, x in zip(words, _words(mask, len(words)))])
    table = spark.createDataFrame([(*_words(1 << bit, len(words)), *rest) for bit, *rest in rows], ", ".join(f"{w}_r long" for w in words) + ", phase int, ord int, inferred string, cls string")
    is_met = reduce(Column.__or__, [F.col(w).bitwiseAND(F.col(f"{w}_r")) != 0 for w in words])
    met = sets.join(F.broadcast(table), is_met).select(*keys, "phase", "ord", "inferred", "cls")
    first = _by_predicates(met.where("phase = 1").withColumnRenamed("cls", "single"), keys)
    if dialect == "owl":
        first = first.where(~((F.col("id_kind") == "iri") & F.col("cls").isin(below("Restriction"))) & ~((F.col("id_kind") == "bnode") & has(inline)))
    asked = first.select(*keys, F.lit(1).alias("phase"), F.lit(0).alias("ord"), "cls").unionByName(met.where("phase = 2").select(*keys, "phase", "ord", "cls"))
    rest = sets.where(has(typed) & (F.col("id_kind") == "iri")).join(asked.select(*keys), keys, "left_anti")
    asked = asked.unionByName(rest.select(*keys, F.lit(2).alias("phase"), F.lit(10_000).alias("ord"), F.lit("Individual").alias("cls")))
    if "later" in keys:
        asked = asked.unionByName(sets.select(*keys, F.explode("later").alias("x")).select(*keys, "x.phase", "x.ord", "x.cls"))
    asked = asked.withColumn("cls", F.when(F.col("is_builtin"), "Datatype").otherwise(F.col("cls")))
    per = asked.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("phase", "ord", "cls"))).alias("r"))
    bnode, free = F.col("id_kind") == "bnode", has(named)

    def step(acc: Column, r: Column) -> Column:
        x = r["cls"]
        return (
            F.when(F.exists(acc, lambda a: _below(a, x)), acc)
            .when((F.size(acc) > 0) & (bnode | ((x == "Individual") & ~free)), acc)
            .when((F.size(acc) == 1) & _below(x, F.try_element_at(acc, F.lit(1))), F.array(x))
            .otherwise(F.concat(acc, F.array(x)))
        )

    return per.select(*keys, F.explode(F.aggregate("r", F.array().cast("array<string>"), step)).alias("cls"))


def entities(triples: DataFrame, dialect: str = "owl", more: DataFrame | None = None) -> DataFrame:
    """id, id_kind, cls after phases 1 and 2, and after further requests (phase from 3) if there are any.

    One pass over the triples tells which rules a node meets, as bits. Its classes follow from that set alone, so requests are
    folded once for each different set, and not for each node.
    """
    words = [f"w{k}" for k in range((len(_masks(dialect)[2]) + 3 + WORD - 1) // WORD)]
    met = materialize(_rules_met(triples, dialect, more, words))
    keys = ["id_kind", "is_builtin", *words] + (["later"] if more is not None else [])
    sets = materialize(met.select(*keys).distinct())
    return met.join(materialize(_resolved(sets, dialect, words)), keys).select("id", "id_kind", "cls")


def population_requests(triples: DataFrame, found: DataFrame, items: DataFrame, dialect: str = "owl") -> DataFrame:
    """id, id_kind, phase, ord, cls that filling in the entities ``found`` asks for: the classes of their values.

    ``triples``: those that fill entities in. Literals ask for nothing. Properties that are only referred to (by
    restrictions, chains, keys, or as equivalent or disjoint ones) are asked for where they have no class yet. Values and
    list items meet the rules in one join each.
    """
    table = F.broadcast(request_frame(triples.sparkSession, dialect))
    subjects = found.groupBy(F.col("id").alias("s")).agg(F.min("cls").alias("own"), F.max(F.col("cls") == "Attribute").alias("is_attribute"))
    ruled = triples.where("o_kind <> 'literal'").join(table, "p").join(subjects, "s")
    columns = ["ord", "asks", "iri_only", "new_only", "free", "own", "is_attribute"]
    direct = ruled.where(~F.col("listed")).select(F.col("o").alias("id"), F.col("o_kind").alias("id_kind"), *columns)
    listed = ruled.where("listed").join(items.withColumnRenamed("head", "o"), "o").where("item_kind <> 'literal'").select(F.col("item").alias("id"), F.col("item_kind").alias("id_kind"), *columns)
    known = found.select("id", F.lit(True).alias("is_known")).distinct()
    rows = direct.unionByName(listed).where((F.col("id") != iri("rdf:nil")) & (~F.col("iri_only") | (F.col("id_kind") == "iri")) & (~F.col("free") | not_structural("id")))
    rows = rows.join(known, "id", "left").where("not new_only or is_known is null")
    cls = F.when(F.col("asks") == RANGE, F.when(F.col("is_attribute"), "Datatype").otherwise("Concept")).when(F.col("asks") == OWN, F.col("own")).otherwise(F.col("asks"))
    return rows.select("id", "id_kind", F.lit(3).alias("phase"), "ord", cls.alias("cls")).distinct()


def count_by_class(found: DataFrame) -> DataFrame:
    return found.groupBy("cls").agg(F.count("*").alias("n"))


def priority(cls: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, c in enumerate(PUNNING_PRIORITY) for x in (F.lit(c), F.lit(k))]), cls), F.lit(len(PUNNING_PRIORITY)))


def dominant(found: DataFrame) -> DataFrame:
    """id, cls: the only class, else the first by punning priority, else the smallest name."""
    return found.groupBy("id").agg(F.min(F.struct(priority(F.col("cls")).alias("k"), "cls")).alias("m")).select("id", "m.cls")


def punned(found: DataFrame) -> DataFrame:
    """id, dominant, others (sorted, comma-separated) of nodes with several classes."""
    per = found.groupBy("id").agg(F.min(F.struct(priority(F.col("cls")).alias("k"), "cls")).alias("m"), F.array_sort(F.collect_set("cls")).alias("all")).where(F.size("all") > 1)
    return per.select("id", F.col("m.cls").alias("dominant"), F.array_join(F.array_remove("all", F.col("m.cls")), ",").alias("others"))


def property_types(triples: DataFrame, found: DataFrame) -> DataFrame:
    """prop, cls, tier for nodes that are no more than generic properties.

    1 an inverse makes a Relation, 2 nearest typed ancestor, 3 nearest typed descendant, 4 range, 5 use as a
    predicate, 6 Annotation.
    """
    concrete = found.where(F.col("cls").isin("Relation", "Attribute", "Annotation")).groupBy("id").agg(F.min("cls").alias("cls"))
    generic = found.where("cls = 'Property' and id_kind = 'iri'").select("id").distinct().join(concrete, "id", "left_anti")
    inverse = match(triples, p="owl:inverseOf")
    tier1 = inverse.select(F.col("s").alias("id")).unionByName(inverse.select(F.col("o").alias("id"))).distinct().select("id", F.lit("Relation").alias("cls"), F.lit(1).alias("tier"))
    above = match(triples, p="rdfs:subPropertyOf").select(F.col("s").alias("a"), F.col("o").alias("b"))
    open_ = generic.join(tier1.select("id"), "id", "left_anti")
    tier2 = search(above, open_, concrete, "cls").select("id", "cls", F.lit(2).alias("tier"))
    tier3 = search(above, open_.join(tier2.select("id"), "id", "left_anti"), concrete, "cls", "down").select("id", "cls", F.lit(3).alias("tier"))
    literal = F.col("o").startswith(PREFIXES["xsd"]) | (F.col("o") == iri("rdfs:Literal"))
    tier4 = match(triples, p="rdfs:range").where("o_kind = 'iri'").groupBy(F.col("s").alias("id")).agg(F.max(literal).alias("l")).select("id", F.when(F.col("l"), "Attribute").otherwise("Relation").alias("cls"), F.lit(4).alias("tier"))
    use = triples.join(generic.select(F.col("id").alias("p")), "p", "left_semi")
    tier5 = use.groupBy(F.col("p").alias("id")).agg(F.max(F.col("o_kind") != "literal").alias("r")).select("id", F.when(F.col("r"), "Relation").otherwise("Attribute").alias("cls"), F.lit(5).alias("tier"))
    ranked = tier1.unionByName(tier2).unionByName(tier3).unionByName(tier4).unionByName(tier5).groupBy("id").agg(F.min(F.struct("tier", "cls")).alias("m"))
    return generic.join(ranked, "id", "left").select(F.col("id").alias("prop"), F.coalesce("m.cls", F.lit("Annotation")).alias("cls"), F.coalesce("m.tier", F.lit(6)).alias("tier"))


def rdf_fallback(triples: DataFrame, found: DataFrame) -> DataFrame:
    """RDF dialect: unmapped predicates are Properties, unmapped IRIs Resources; structural terms and list nodes aren't."""
    predicates = triples.select(F.col("p").alias("id")).where(not_structural("id")).distinct()
    ends = triples.where("s_kind = 'iri'").select(F.col("s").alias("id")).unionByName(triples.where("o_kind = 'iri'").select(F.col("o").alias("id"))).where(not_structural("id")).distinct()
    nodes = match(triples, p="rdf:first").select(F.col("s").alias("id"))
    new = predicates.join(found, "id", "left_anti").withColumn("cls", F.lit("Property"))
    rest = ends.join(found, "id", "left_anti").join(predicates, "id", "left_anti").join(nodes, "id", "left_anti").withColumn("cls", F.lit("Resource"))
    return new.unionByName(rest)
