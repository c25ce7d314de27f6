"""What no rule consumes becomes statements; nested nodes, blank-node closures and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import in_namespaces, local_name
from ..rules import PARENTS, PUNNING_PRIORITY, below, namespaces, predicate_rules, type_rules
from ..vocab import FACETS, STRUCTURAL_PREDICATES, iri
from .closure import _among, materialize, spread
from .patterns import match, not_structural
from .populate import memberships

TRIPLE = ["s", "p", "o", "o_lang"]


def consumed(triples: DataFrame, found: DataFrame, dialect: str = "owl") -> DataFrame:
    """Triples that fill in an entity: s, p, o, o_lang."""
    return filling(triples, found, dialect).select(*TRIPLE).distinct()


def filling(triples: DataFrame, found: DataFrame, dialect: str = "owl") -> DataFrame:
    """The rows of ``triples`` that fill in an entity; some may come twice.

    The predicate's namespace is the dialect's, the subject has a class below one of the rule's targets, and
    that class is its dominant one or a target itself. A rule without handler or setter consumes only
    lists, as does an unmapped predicate of those namespaces; a property chain that is no list is left.
    The members of containers fill them in, too.

    So the dominant class is below a target, or another class is a target. Classes are bits, by punning priority and name:
    the lowest is the dominant one. Rules are met after the subjects, so that nothing of them is shuffled.
    """
    spark, columns = triples.sparkSession, triples.columns
    taking = [r.name for r in predicate_rules(dialect) if (r.handler or r.setters) and r.handler != "property_chain"]
    bits = {c: 1 << k for k, c in enumerate(sorted(PARENTS, key=lambda c: (PUNNING_PRIORITY.index(c) if c in PUNNING_PRIORITY else len(PUNNING_PRIORITY), c)))}
    rows = [(r.name, sum({bits[x] for x in r.targets}), sum({bits[c] for x in r.targets for c in below(x)})) for r in predicate_rules(dialect)]
    table = F.broadcast(spark.createDataFrame(rows, "p string, targets long, accepted long"))
    scope = triples.where(in_namespaces(F.col("p"), namespaces(dialect)))
    takes = F.col("p").isin(taking)
    bit = F.try_element_at(F.create_map(*[F.lit(x).cast(kind) for c, k in bits.items() for x, kind in ((c, "string"), (k, "long"))]), F.col("cls"))
    kinds = found.where(F.col("cls").isin(list(bits))).groupBy(F.col("id").alias("s")).agg(F.bit_or(bit).alias("classes"))
    main = F.col("classes").bitwiseAND(-F.col("classes"))
    fits = F.col("accepted").isNull() | (main.bitwiseAND(F.col("accepted")).bitwiseOR(F.col("classes").bitwiseAND(F.col("targets"))) != 0)
    filled = lambda rows: rows.join(kinds, "s").join(table, "p", "left").where(fits).select(*columns)
    # What takes lists alone: the nodes of lists are many, but few are entities, and few of their objects are heads.
    open_ = scope.where(~takes)
    cells = open_.where(is_cell())
    blank = found.where("id_kind = 'bnode'").select(F.col("id").alias("s")).distinct()
    named = materialize(cells.where("s_kind <> 'bnode'").select("s").distinct())
    own = cells.where("s_kind = 'bnode'").select("s").join(blank.hint("shuffle_hash"), "s", "left_semi")
    own = materialize(own.unionByName(found.where("id_kind <> 'bnode'").select(F.col("id").alias("s")).join(named, "s", "left_semi")).distinct())
    listed = materialize(filled(open_.where(~is_cell()).unionByName(cells.join(own, "s", "left_semi").select(*columns))))
    heads = materialize(match(triples, p="rdf:first").select(F.col("s").alias("o")).join(listed.select("o"), "o", "left_semi").distinct())
    return filled(scope.where(takes)).unionByName(listed.join(heads, "o", "left_semi").select(*columns)).unionByName(memberships(triples).select(*columns))


def is_cell():
    """Triples that make up lists."""
    return F.col("p").isin(iri("rdf:first"), iri("rdf:rest"))


def structured_nodes(triples: DataFrame, found: DataFrame, dialect: str = "owl") -> DataFrame:
    """id of blank nodes that have triples but no entity and no mapped type; list nodes aren't among them.

    Nodes of lists are many: the others are found without them, and only these are looked for among lists.
    """
    mapped = [r.name for r in type_rules(dialect)]
    blank = triples.where("s_kind = 'bnode'")
    out = (F.col("p") == iri("rdf:type")) & F.col("o").isin(mapped)
    nodes = blank.where(~is_cell()).groupBy(F.col("s").alias("id")).agg(F.max(out).alias("is_out")).where("not is_out").select("id")
    nodes = materialize(nodes.join(found.where("id_kind = 'bnode'").select("id"), "id", "left_anti"))
    cells = materialize(blank.where(is_cell()).select(F.col("s").alias("id")).join(nodes, "id", "left_semi").distinct())
    return nodes.join(cells, "id", "left_anti")


def statements(triples: DataFrame, found: DataFrame, dialect: str = "owl") -> DataFrame:
    """s, p, o, o_lang of the triples that become one statement each."""
    return left_over(triples, found, dialect).select(*TRIPLE).distinct()


def left_over(triples: DataFrame, found: DataFrame, dialect: str = "owl") -> DataFrame:
    """s, s_kind, p, o, o_kind, o_lang of the triples that become statements, as often as they are there.

    Only triples of the dialect's namespaces can be consumed, and only blank nodes can be structured, so no others are compared.
    """
    is_type, columns = F.col("p") == iri("rdf:type"), ["s", "s_kind", "p", "o", "o_kind", "o_lang"]
    used = filling(triples, found, dialect).where(~is_type).select(*TRIPLE)
    scope = triples.where(~F.col("p").isin([iri(p) for p in STRUCTURAL_PREDICATES]) & ~is_type).select(*columns)
    inside = F.lit(False)
    for ns in namespaces(dialect):
        inside = inside | F.col("s").startswith(ns)
    typed = match(triples, p="rdf:type").where(inside).select("s").distinct()
    vocabulary = materialize(scope.where(inside).select("s").distinct().join(typed, "s", "left_anti"))
    nested = materialize(structured_nodes(triples, found, dialect).select(F.col("id").alias("s")))
    named = in_namespaces(F.col("p"), namespaces(dialect))
    left = scope.where(~F.coalesce(named, F.lit(False))).unionByName(scope.where(named).join(used, TRIPLE, "left_anti").select(*columns))
    blank = left.where("s_kind = 'bnode'").join(nested, "s", "left_anti").select(*columns)
    return left.where("s_kind <> 'bnode'").unionByName(blank).join(vocabulary, "s", "left_anti").select(*columns)


def nested_parts(triples: DataFrame, found: DataFrame, items: DataFrame, dialect: str = "owl") -> DataFrame:
    """id, attr, pos, p, o, kind: a row for each triple of a structured node.

    The smallest pair of a node fills the slots of its statement (attr ``has_object``, pos 0); the others are sides, named by
    the predicate and numbered from 1. kind: literal, container (a list), statement (another structured node), entity. Types,
    list and member links don't count, nor do facets and inline inverses, which restrictions consume.
    """
    nodes = materialize(structured_nodes(triples, found, dialect))
    inline = match(triples, p="owl:onProperty").select(F.col("o").alias("s"), F.lit(iri("owl:inverseOf")).alias("p")).distinct()
    left = triples.where("s_kind = 'bnode'").where(~F.col("p").isin([iri(p) for p in [*STRUCTURAL_PREDICATES, "rdf:type", *FACETS]])).join(nodes.select(F.col("id").alias("s")), "s", "left_semi")
    own = left.join(inline, ["s", "p"], "left_anti").select(F.col("s").alias("id"), "p", "o", "o_lang", "o_kind").distinct()
    main = own.groupBy("id").agg(F.min(F.struct("p", "o", "o_lang")).alias("m"))
    is_main = F.struct("p", "o", "o_lang") == F.col("m")
    attr = F.when(is_main, "has_object").otherwise(local_name(F.col("p")))
    placed = own.join(main, "id").select("id", attr.alias("attr"), is_main.alias("is_main"), "p", "o", "o_lang", "o_kind")
    place = F.row_number().over(Window.partitionBy("id", "is_main", "attr").orderBy("p", "o", "o_lang"))
    heads = items.select(F.col("head").alias("o"), F.lit("container").alias("as_list")).distinct()
    inner = nodes.select(F.col("id").alias("o"), F.lit("statement").alias("as_node"))
    kinds = placed.withColumn("pos", F.when(F.col("is_main"), 0).otherwise(place)).join(heads, "o", "left").join(inner, "o", "left")
    return kinds.select("id", "attr", "pos", "p", "o", F.when(F.col("o_kind") == "literal", "literal").otherwise(F.coalesce("as_list", "as_node", F.lit("entity"))).alias("kind"))


def nested_values(parts: DataFrame) -> DataFrame:
    """id, path, v, kind: every structured node with all that hangs below it, from the inside out.

    A round folds the nodes whose inner nodes are folded, looking only at those that hold a node of the last round. A path
    names attributes and positions: ``when0/year1``. Nodes on circles, and those that hold one, keep their links to
    structured nodes as values of kind ``statement``.
    """
    parts = materialize(parts.withColumn("step", F.concat("attr", F.col("pos").cast("string"))))
    inner = materialize(parts.where("kind = 'statement'").select("id", "step", F.col("o").alias("below")))
    leaves = parts.where("kind <> 'statement'").select("id", F.col("step").alias("path"), F.col("o").alias("v"), "kind")
    last = materialize(parts.select("id").distinct().join(inner.select("id"), "id", "left_anti"))
    folded, done = materialize(leaves.join(last, "id", "left_semi")), last
    while not last.isEmpty():
        holds = inner.join(last.withColumnRenamed("id", "below"), "below", "left_semi").select("id").distinct()
        open_ = inner.join(done.withColumnRenamed("id", "below"), "below", "left_anti").select("id")
        last = materialize(holds.join(open_, "id", "left_anti").join(done, "id", "left_anti"))
        links = inner.join(last, "id", "left_semi").join(folded.withColumnRenamed("id", "below").withColumnRenamed("path", "rest"), "below")
        new = leaves.join(last, "id", "left_semi").unionByName(links.select("id", F.concat("step", F.lit("/"), "rest").alias("path"), "v", "kind"))
        folded, done = folded.unionByName(materialize(new)), done.unionByName(last)
    circles = parts.join(done, "id", "left_anti").select("id", F.col("step").alias("path"), F.col("o").alias("v"), "kind")
    return folded.unionByName(circles)


def nested_statements(triples: DataFrame, found: DataFrame, dialect: str = "owl") -> DataFrame:
    """id, predicate, object, n_sides of each structured node: its slots, and how many triples annotate them."""
    parts = nested_parts(triples, found, triples.sparkSession.createDataFrame([], "head string"), dialect)
    slot = F.when(F.col("pos") == 0, F.struct("p", "o"))
    return parts.groupBy("id").agg(F.max(slot).alias("m"), (F.count("*") - 1).alias("n_sides")).select("id", F.col("m.p").alias("predicate"), F.col("m.o").alias("object"), "n_sides")


def made_entities(triples: DataFrame, found: DataFrame, made: DataFrame, parts: DataFrame) -> DataFrame:
    """id, id_kind, cls of nodes that only statements mention, ``made`` ones (s, p, o, o_lang, as ``left_over`` gives them also
    with their kinds, else these are looked up) and nested ones.

    Predicates without a property class are Annotations. Unknown subjects are Individuals (terms of the vocabularies
    Resources), unknown objects of statements Resources and of nested ones Individuals, structured nodes Statements and lists
    Containers; terms of the vocabularies that are only objects are left out. Nodes are gathered once and met by id alone, and
    only they are looked for among the nodes of lists.
    """
    own = made if {"s_kind", "o_kind"} <= set(made.columns) else triples.join(made, TRIPLE, "left_semi")
    properties = found.where(F.col("cls").isin(below("Property"))).select("id")
    predicates = own.select(F.col("p").alias("id")).unionByName(parts.select(F.col("p").alias("id"))).distinct().join(properties, "id", "left_anti")
    predicates = materialize(predicates.select("id", F.lit("iri").alias("id_kind"), F.lit("Annotation").alias("cls")))
    node = lambda df, id, kind, cls, asked=F.lit(False): df.select(F.col(id).alias("id"), *[F.when(kind == k, cls).alias(k) for k in ("iri", "bnode")], asked.alias("asked"))
    subjects = node(own, "s", F.col("s_kind"), F.when(not_structural("s"), "Individual").otherwise("Resource"))
    objects = node(own.where((F.col("o_kind") != "literal") & not_structural("o")), "o", F.col("o_kind"), F.lit("Resource"), F.col("o_kind") == "bnode")
    inner = node(parts.where((F.col("kind") == "entity") & not_structural("o")), "o", F.when(F.col("o").startswith("_:"), "bnode").otherwise("iri"), F.lit("Individual"))
    lists = node(parts.where("kind = 'container'"), "o", F.lit(""), F.lit("Container"), F.lit(True))
    ends = subjects.unionByName(objects).unionByName(inner).unionByName(lists).groupBy("id")
    ends = ends.agg(F.min("iri").alias("iri"), F.min("bnode").alias("bnode"), F.max("asked").alias("asked"))  # an Individual is a Resource
    ends = materialize(ends.join(found.select("id"), "id", "left_anti"))
    heads = materialize(_among(match(triples, p="rdf:first").select(F.col("s").alias("id")), ends, "id").distinct())
    nodes = materialize(parts.select("id").distinct())
    containers = ends.where("asked").join(heads, "id", "left_semi")
    for known in (heads, nodes, predicates.select("id")):
        ends = ends.join(known, "id", "left_anti")
    ends = ends.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("id_kind"), F.col(k).alias("cls")) for k in ("iri", "bnode")])).alias("e")).select("id", "e.*").where("cls is not null")
    blank = lambda df, cls: df.select("id", F.lit("bnode").alias("id_kind"), F.lit(cls).alias("cls"))
    return predicates.unionByName(ends).unionByName(blank(nodes, "Statement")).unionByName(blank(containers, "Container"))


#: Kinds of nodes that are about a triple, with the predicates that name its subject, predicate and object.
REIFIED = {
    "owl:Axiom": ("owl:annotatedSource", "owl:annotatedProperty", ["owl:annotatedTarget"]),
    "owl:Annotation": ("owl:annotatedSource", "owl:annotatedProperty", ["owl:annotatedTarget"]),
    "owl:NegativePropertyAssertion": ("owl:sourceIndividual", "owl:assertionProperty", ["owl:targetIndividual", "owl:targetValue"]),
    "rdf:Statement": ("rdf:subject", "rdf:predicate", ["rdf:object"]),
}


def reified(triples: DataFrame) -> DataFrame:
    """id, kind, s, p, o, o_lang, is_positive, is_asserted of nodes that are about a triple: one pass pivots their links.

    Of several links of one sort the smallest counts; a node that lacks subject, predicate or object is about none.
    is_asserted: the graph has the triple itself.
    """
    spark = triples.sparkSession
    kinds = spark.createDataFrame([(iri(k), k) for k in REIFIED], "o string, kind string")
    links = spark.createDataFrame([(k, iri(p), slot) for k, (s, p0, os) in REIFIED.items() for slot, ps in (("s", [s]), ("p", [p0]), ("o", os)) for p in ps], "kind string, p string, slot string")
    nodes = match(triples, p="rdf:type").join(F.broadcast(kinds), "o").select(F.col("s").alias("id"), "kind").distinct()
    filled = triples.withColumnRenamed("s", "id").join(F.broadcast(links), "p").join(nodes, ["id", "kind"])
    pick = lambda slot: F.min(F.when(F.col("slot") == slot, F.struct("o", "o_lang"))).alias(slot)
    about = filled.groupBy("id", "kind").agg(pick("s"), pick("p"), pick("o")).where("s is not null and p is not null and o is not null")
    about = about.select("id", "kind", F.col("s.o").alias("s"), F.col("p.o").alias("p"), F.col("o.o").alias("o"), F.col("o.o_lang").alias("o_lang"), (F.col("kind") != "owl:NegativePropertyAssertion").alias("is_positive"))
    there = triples.select("s", "p", "o", F.lit(True).alias("is_there")).distinct()
    return about.join(there, ["s", "p", "o"], "left").select("id", "kind", "s", "p", "o", "o_lang", "is_positive", F.coalesce("is_there", F.lit(False)).alias("is_asserted"))


def triple_annotations(triples: DataFrame, about: DataFrame | None = None) -> DataFrame:
    """s, p, o, attr, v, v_lang, is_positive: what nodes say about their triples, hung on the triples themselves."""
    about = reified(triples) if about is None else about
    links = [iri(p) for s, p0, os in REIFIED.values() for p in (s, p0, *os)]
    said = triples.where(~F.col("p").isin([*links, iri("rdf:type")])).select(F.col("s").alias("id"), F.col("p").alias("attr"), F.col("o").alias("v"), F.col("o_lang").alias("v_lang"))
    return about.join(said, "id").select("s", "p", "o", "attr", "v", "v_lang", "is_positive").distinct()


def list_objects(made: DataFrame, items: DataFrame) -> DataFrame:
    """id, idx, item: the lists that statements have as objects. Each is a Container of its own with these members."""
    return made.select(F.col("o").alias("head")).distinct().join(items, "head").select(F.col("head").alias("id"), "idx", "item")


def bnode_closure(triples: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """root, s, p, o: triples of all blank nodes that an IRI reaches through blank nodes."""
    return _inside(triples, roots).distinct()


def _inside(triples: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """``bnode_closure``, its rows as often as the triples have them."""
    links = triples.where("o_kind = 'bnode'").select(F.col("s").alias("a"), F.col("o").alias("b"), (F.col("s_kind") == "bnode").alias("is_inner"))
    if roots is not None:
        links = links.where("is_inner").unionByName(links.where("not is_inner").join(roots.select(F.col("root").alias("a")), "a", "left_semi").select("a", "b", "is_inner"))
    nodes = spread(materialize(links))
    own = triples.where("s_kind = 'bnode'").select(F.col("s").alias("node"), "p", "o")
    return nodes.join(own, "node").select("root", F.col("node").alias("s"), "p", "o")


def provenance(triples: DataFrame, axioms: DataFrame | None = None) -> DataFrame:
    """root, s, p, o: an IRI's own triples, its blank-node closure, and the group axioms that list it.

    ``axioms``: (owner, item) of group axioms and their members.
    """
    own = triples.where("s_kind = 'iri'").select(F.col("s").alias("root"), "s", "p", "o")
    out = own.unionByName(_inside(triples))
    if axioms is not None:
        part = axioms.select(F.col("item").alias("root"), F.col("owner").alias("s")).distinct().join(triples.select("s", "p", "o"), "s").select("root", "s", "p", "o")
        out = out.unionByName(part)
    return out.distinct()
