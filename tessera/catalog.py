"""Registered queries over lifted tables, each with the SQL that it is compared with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rules as R
from .functions import text as X
from .lift import THESAURUS, lift, lift_sql
from .operators import axioms, classify, closure, patterns, populate, quality, retract, statements
from .plans import cards, skos, values, views
from .plans.engine import Ontology
from .sinks import serialize
from .sources import imports, spool, validate
from .vocab import BUILTIN_DATATYPES, FACETS, PREFIXES, STRUCTURAL_PREDICATES, iri

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LISTS = ["rdf:first", "rdf:rest"]


def _longs(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c, kind in df.dtypes if kind == "int"})


def register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: _longs(run(spark, sf_dir))
    ORACLES[name] = sql


def on_triples(name: str, run: Callable[[DataFrame], DataFrame], sql: str, predicates: list[str] | None = None, shared: bool = False) -> None:
    """``sql`` goes on after a WITH clause in which ``t`` has the triples.

    Operators that look at the graph from many sides (``shared``, and all that need entities or lists) get it written
    once; others read only the tables and columns behind their own predicates.
    """
    once = shared or sql.startswith((C1, ITEMS))
    register(name, lambda spark, d: run(closure.materialize(lift(spark, d, predicates)) if once else lift(spark, d, predicates)), f"WITH RECURSIVE t AS MATERIALIZED ({lift_sql(predicates)}){sql}")


def _q(curie: str) -> str:
    return f"'{iri(curie)}'"


def _in(*curies: str) -> str:
    return "(" + ", ".join(map(_q, curies)) + ")"


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    def one(v) -> str:
        if v is None:
            return "CAST(NULL AS VARCHAR)"
        if isinstance(v, list):
            return "[" + ", ".join(map(one, v)) + "]"
        return f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else str(v).lower()

    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)})"


ITEMS = f""", walk AS (
  SELECT s AS head, s AS node, 1 AS idx FROM t WHERE p = {_q('rdf:first')} AND s NOT IN (SELECT o FROM t WHERE p = {_q('rdf:rest')})
  UNION SELECT w.head, r.o, w.idx + 1 FROM walk w JOIN t r ON r.s = w.node AND r.p = {_q('rdf:rest')} AND r.o <> {_q('rdf:nil')}),
items AS (SELECT DISTINCT w.head, CAST(w.idx AS BIGINT) AS idx, f.o AS item, f.o_kind AS item_kind FROM walk w JOIN t f ON f.s = w.node AND f.p = {_q('rdf:first')})"""

PAIRS = "[" + ", ".join(f"'{a}<{b}'" for a, up in R.lattice().items() for b in up) + "]"
PRIORITY = "CASE cls " + " ".join(f"WHEN '{c}' THEN {k}" for k, c in enumerate(R.PUNNING_PRIORITY)) + f" ELSE {len(R.PUNNING_PRIORITY)} END"


def _rules_sql(dialect: str = "owl") -> str:
    pr = [(r.name, r.ord, r.inferred, r.targets[0] if len(r.targets) == 1 else None, r.targets, r.handler or "", bool(r.handler or r.setters)) for r in R.predicate_rules(dialect)]
    tr = [(r.name, r.ord, r.targets[0]) for r in R.type_rules(dialect)]
    return ", " + _values("pr", "p, ord, inferred, single, targets, handler, acts", pr) + ", " + _values("tr", "o, ord, cls", tr)


C1 = f"""{_rules_sql()},
cand AS (SELECT DISTINCT s AS id, s_kind AS id_kind, ord, inferred, single FROM t JOIN pr USING (p)),
folds AS (SELECT id, id_kind, list(inferred ORDER BY ord) FILTER (inferred IS NOT NULL) AS l, min(ord) FILTER (single IS NOT NULL) AS so FROM cand GROUP BY id, id_kind),
c1 AS (
  SELECT id, id_kind, coalesce(CASE WHEN l IS NOT NULL THEN list_reduce(l, lambda a, x: CASE WHEN list_contains({PAIRS}, x || '<' || a) THEN x ELSE a END) END, single) AS cls
  FROM folds LEFT JOIN pr ON pr.ord = so),
p1 AS (
  SELECT * FROM c1 WHERE cls IS NOT NULL
    AND NOT (id_kind = 'iri' AND cls IN ({', '.join(f"'{c}'" for c in R.below('Restriction'))}))
    AND NOT (id_kind = 'bnode' AND id IN (SELECT o FROM t WHERE p = {_q('owl:onProperty')})))"""

ENTITIES = (
    C1
    + f""",
typed AS (SELECT DISTINCT s AS id, s_kind AS id_kind, tr.ord, tr.cls FROM t JOIN tr ON t.o = tr.o WHERE p = {_q('rdf:type')}),
asked AS (SELECT id, id_kind, 1 AS ph, 0 AS ord, cls FROM p1 UNION ALL SELECT id, id_kind, 2, ord, cls FROM typed),
reqs AS (
  SELECT * FROM asked UNION ALL
  SELECT DISTINCT s, s_kind, 2, 10000, 'Individual' FROM t WHERE p = {_q('rdf:type')} AND s_kind = 'iri' AND s NOT IN (SELECT id FROM asked)),
fixed AS (SELECT DISTINCT id, id_kind, ph, ord, CASE WHEN id_kind = 'iri' AND (starts_with(id, '{PREFIXES['xsd']}') OR id IN {_in(*BUILTIN_DATATYPES)}) THEN 'Datatype' ELSE cls END AS cls FROM reqs),
named AS (SELECT DISTINCT s AS id FROM t WHERE p = {_q('rdf:type')} AND o = {_q('owl:NamedIndividual')}),
gathered AS (SELECT id, id_kind, list(cls ORDER BY ph, ord, cls) AS l, id IN (SELECT id FROM named) AS is_named FROM fixed GROUP BY id, id_kind),
ent AS MATERIALIZED (
  SELECT id, id_kind, unnest(list_reduce(list_transform(l, lambda c: [c]), lambda acc, x: CASE
    WHEN len(list_filter(acc, lambda a: list_contains({PAIRS}, a || '<' || x[1]))) > 0 THEN acc
    WHEN len(acc) > 0 AND (id_kind = 'bnode' OR (x[1] = 'Individual' AND NOT is_named)) THEN acc
    WHEN len(acc) = 1 AND list_contains({PAIRS}, x[1] || '<' || acc[1]) THEN x
    ELSE list_concat(acc, x) END, CAST([] AS VARCHAR[]))) AS cls
  FROM gathered),
main AS (SELECT id, arg_min(cls, ({PRIORITY}, cls)) AS main FROM ent GROUP BY id)"""
)


def _reach(p: str) -> str:
    """Pairs (a, b, depth) over p, by the least depth."""
    return f""", steps AS (SELECT DISTINCT s AS a, o AS b FROM t WHERE p = {_q(p)} AND s <> o),
ways AS (SELECT a, b, 1 AS depth FROM steps UNION SELECT w.a, s.b, depth + 1 FROM ways w JOIN steps s ON w.b = s.a WHERE depth < 40),
reach AS MATERIALIZED (SELECT a, b, CAST(min(depth) AS BIGINT) AS depth FROM ways WHERE a <> b GROUP BY a, b)"""


# ------------------------------------------------------------------ triples and classification

on_triples("src_lift_triples_by_predicate", patterns.by_predicate, " SELECT p, count(*) AS n FROM t GROUP BY p")
on_triples("tp_namespace_filter", lambda t: patterns.by_namespace(t, "owl"), f", n AS (SELECT CASE WHEN p LIKE '%#%' THEN regexp_extract(p, '^(.*#)', 1) ELSE regexp_extract(p, '^(.*/)', 1) END AS ns FROM t) SELECT ns, count(*) AS n FROM n WHERE ns IN ({', '.join(repr(x) for x in R.namespaces('owl'))}) GROUP BY ns")
on_triples("tp_pattern_value", lambda t: patterns.value(t, "rdfs:label"), f" SELECT s, arg_min(o, (o_lang, o)) AS o FROM t WHERE p = {_q('rdfs:label')} GROUP BY s", ["rdfs:label"])
on_triples("tp_exists", lambda t: patterns.having(patterns.match(t, p="rdfs:subClassOf").select(F.col("s").alias("id")).distinct(), "id", t, "rdfs:label"), f" SELECT DISTINCT s AS id FROM t WHERE p = {_q('rdfs:subClassOf')} AND s IN (SELECT s FROM t WHERE p = {_q('rdfs:label')})", ["rdfs:label", "rdfs:subClassOf"])
on_triples("c1_classify_by_predicate", lambda t: classify.predicate_requests(t).select("id", "cls"), C1 + " SELECT id, cls FROM p1")
on_triples("c5_create_from_types", classify.created_from_types, _rules_sql() + f", m AS (SELECT DISTINCT s AS id, cls FROM t JOIN tr ON t.o = tr.o WHERE p = {_q('rdf:type')}) SELECT id, cls FROM m UNION ALL SELECT DISTINCT s, 'Individual' FROM t WHERE p = {_q('rdf:type')} AND s_kind = 'iri' AND s NOT IN (SELECT id FROM m)", ["rdf:type"])
on_triples("c8_identity_counts", lambda t: classify.count_by_class(classify.entities(t)), ENTITIES + " SELECT cls, count(*) AS n FROM ent GROUP BY cls")
on_triples("c12_punning", lambda t: classify.punned(classify.entities(t)), ENTITIES + " SELECT id, main AS dominant, string_agg(cls, ',' ORDER BY cls) AS others FROM ent JOIN main USING (id) WHERE cls <> main GROUP BY id, main")
on_triples(
    "c14_property_type", lambda t: classify.property_types(t, classify.entities(t)),
    ENTITIES + _reach("rdfs:subPropertyOf") + f""",
concrete AS (SELECT id, min(cls) AS cls FROM ent WHERE cls IN ('Relation', 'Attribute', 'Annotation') GROUP BY id),
generic AS (SELECT DISTINCT id FROM ent WHERE cls = 'Property' AND id_kind = 'iri' AND id NOT IN (SELECT id FROM concrete)),
tiers AS (
  SELECT s AS id, 'Relation' AS cls, 1 AS tier FROM t WHERE p = {_q('owl:inverseOf')} UNION ALL SELECT o, 'Relation', 1 FROM t WHERE p = {_q('owl:inverseOf')}
  UNION ALL SELECT a, arg_min(cls, (depth, cls)), 2 FROM reach JOIN concrete ON b = id GROUP BY a
  UNION ALL SELECT b, arg_min(cls, (depth, cls)), 3 FROM reach JOIN concrete ON a = id GROUP BY b
  UNION ALL SELECT s, CASE WHEN bool_or(starts_with(o, '{PREFIXES['xsd']}') OR o = {_q('rdfs:Literal')}) THEN 'Attribute' ELSE 'Relation' END, 4 FROM t WHERE p = {_q('rdfs:range')} AND o_kind = 'iri' GROUP BY s
  UNION ALL SELECT p, CASE WHEN bool_or(o_kind <> 'literal') THEN 'Relation' ELSE 'Attribute' END, 5 FROM t GROUP BY p)
SELECT g.id AS prop, coalesce(arg_min(cls, (tier, cls)), 'Annotation') AS cls, CAST(coalesce(min(tier), 6) AS BIGINT) AS tier FROM generic g LEFT JOIN tiers x ON x.id = g.id GROUP BY g.id""",
)
on_triples("c15_rdf_fallback", lambda t: classify.rdf_fallback(t, classify.created_from_types(t, "rdf").withColumn("id_kind", F.lit("iri"))).groupBy("cls").agg(F.count("*").alias("n")), _rules_sql("rdf") + f""",
m AS (SELECT DISTINCT s AS id FROM t WHERE p = {_q('rdf:type')} AND (s_kind = 'iri' OR o IN (SELECT o FROM tr))),
preds AS (SELECT DISTINCT p AS id FROM t WHERE NOT ({' OR '.join(f"starts_with(p, '{PREFIXES[x]}')" for x in ('rdf', 'rdfs', 'owl', 'skos', 'xsd'))})),
ends AS (SELECT id FROM (SELECT s AS id FROM t WHERE s_kind = 'iri' UNION SELECT o FROM t WHERE o_kind = 'iri') WHERE NOT ({' OR '.join(f"starts_with(id, '{PREFIXES[x]}')" for x in ('rdf', 'rdfs', 'owl', 'skos', 'xsd'))}))
SELECT 'Property' AS cls, count(*) AS n FROM preds WHERE id NOT IN (SELECT id FROM m) HAVING count(*) > 0
UNION ALL SELECT 'Resource', count(*) FROM ends WHERE id NOT IN (SELECT id FROM m) AND id NOT IN (SELECT id FROM preds) HAVING count(*) > 0""", shared=True)

# ------------------------------------------------------------------ population

on_triples("h1_literals", populate.literals, f" SELECT DISTINCT s AS id, CASE p WHEN {_q('rdfs:label')} THEN 'has_label' WHEN {_q('rdfs:comment')} THEN 'has_comment' ELSE 'has_object' END AS attr, o AS v, o_lang AS lang FROM t WHERE o_kind = 'literal' AND p IN {_in('rdfs:label', 'rdfs:comment', 'owl:targetValue')}", ["rdfs:label", "rdfs:comment"])
_STRUCTURAL = " OR ".join(f"starts_with(o, '{PREFIXES[x]}')" for x in ("rdf", "rdfs", "owl", "skos", "xsd"))
on_triples("h27_types", populate.types, f" SELECT DISTINCT s AS id, o AS type FROM t WHERE p = {_q('rdf:type')} AND (NOT ({_STRUCTURAL}) OR o IN {_in('owl:Thing', 'owl:Nothing', 'rdfs:Literal')})", ["rdf:type"])
on_triples("h27_individuals_by_type", populate.individuals_by_type, f" SELECT o AS type, count(DISTINCT s) AS n FROM t WHERE p = {_q('rdf:type')} AND (NOT ({_STRUCTURAL}) OR o IN {_in('owl:Thing', 'owl:Nothing', 'rdfs:Literal')}) GROUP BY o", ["rdf:type"])
for _name, _p in (("h5_equivalent_class", "owl:equivalentClass"), ("h6_disjoint", "owl:disjointWith"), ("h7_equivalent_property", "owl:equivalentProperty"), ("h8_property_disjoint", "owl:propertyDisjointWith"), ("h9_same_as", "owl:sameAs"), ("h10_different_from", "owl:differentFrom"), ("h11_inverse", "owl:inverseOf")):
    on_triples(_name, lambda t, p=_p: populate.symmetric(t, p), f", e AS (SELECT s AS a, o AS b FROM t WHERE p = {_q(_p)} AND o_kind <> 'literal' AND s <> o) SELECT a, b FROM e UNION SELECT b, a FROM e", [_p])
_ON_PROPERTY = f""", inv AS (SELECT s, min(o) AS o FROM t WHERE p = {_q('owl:inverseOf')} AND s_kind = 'bnode' GROUP BY s),
onp AS (SELECT t.s AS restriction, coalesce(inv.o, t.o) AS property, inv.o IS NOT NULL AS is_inverse FROM t LEFT JOIN inv ON inv.s = t.o WHERE p = {_q('owl:onProperty')}),
prop AS (SELECT restriction AS id, min(property) AS property FROM onp GROUP BY restriction)"""
on_triples("h12_on_property", populate.on_property, _ON_PROPERTY + " SELECT * FROM onp", ["owl:onProperty", "owl:inverseOf"])
for _name, _ps in (("h13_chain", ["owl:propertyChainAxiom"]), ("h14_keys", ["owl:hasKey"]), ("h15_disjoint_union", ["owl:disjointUnionOf"]), ("h24_one_of", ["owl:oneOf"])):
    on_triples(_name, lambda t, ps=_ps: populate.list_values(t, closure.list_items(t), *ps).select("owner", "idx", "item"), ITEMS + f" SELECT s AS owner, idx, item FROM t JOIN items ON head = o WHERE p IN {_in(*_ps)}", [*_ps, *LISTS])
on_triples("h28_collections", lambda t: populate.collections(t, closure.list_items(t)).groupBy("owner", "p").agg(F.count("*").alias("n"), F.max(F.struct("idx", "item"))["item"].alias("last")), ITEMS + _rules_sql() + f" SELECT s AS owner, p, count(*) AS n, arg_max(item, (idx, item)) AS last FROM t JOIN items ON head = o WHERE p NOT IN (SELECT p FROM pr) AND p NOT IN {_in(*LISTS)} GROUP BY s, p")
_FACETS = "CASE p " + " ".join(f"WHEN {_q(k)} THEN '{v}'" for k, v in FACETS.items()) + " END"
on_triples("h16_facets", lambda t: populate.facets(t, closure.list_items(t)), ITEMS + f", n AS (SELECT s AS id, idx, item FROM t JOIN items ON head = o WHERE p = {_q('owl:withRestrictions')}), d AS (SELECT s, min(o) AS datatype FROM t WHERE p = {_q('owl:onDatatype')} GROUP BY s) SELECT n.id, n.idx, {_FACETS} AS comparator, t.o AS v, datatype FROM n JOIN t ON t.s = n.item AND t.p IN {_in(*FACETS)} LEFT JOIN d ON d.s = n.id", ["owl:withRestrictions", "owl:onDatatype", *FACETS, *LISTS])
_CARD = "CASE p " + " ".join(f"WHEN {_q(k)} THEN '{v}'" for k, v in populate.CARDINALITIES.items()) + " END"
_CARD_SQL = _ON_PROPERTY + f""", k AS (SELECT s AS id, min(({_CARD}, TRY_CAST(o AS INT))) AS c FROM t WHERE p IN {_in(*populate.CARDINALITIES)} GROUP BY s),
card AS (SELECT k.id, c[1] AS kind, CAST(c[2] AS BIGINT) AS n, property, coalesce((SELECT min(o) FROM t WHERE s = k.id AND p = {_q('owl:onClass')}), (SELECT min(o) FROM t WHERE s = k.id AND p = {_q('owl:onDataRange')}), {_q('owl:Thing')}) AS filler FROM k LEFT JOIN prop ON prop.id = k.id)"""
_RESTRICTIONS = ["owl:onProperty", "owl:inverseOf"]
on_triples("h17_cardinality", populate.cardinalities, _CARD_SQL + " SELECT id, kind, n, property, filler FROM card", [*_RESTRICTIONS, *populate.CARDINALITIES, "owl:onClass", "owl:onDataRange"])
_TRUTH_SQL = f""", truth AS (
  SELECT s AS id, CASE p WHEN {_q('owl:intersectionOf')} THEN 'and' ELSE 'or' END AS operator, count(item) AS n, coalesce(string_agg(item, ',' ORDER BY idx), '') AS members FROM t LEFT JOIN items ON head = o WHERE p IN {_in('owl:intersectionOf', 'owl:unionOf')} GROUP BY s, p
  UNION ALL SELECT s, 'not', 1, o FROM t WHERE p = {_q('owl:complementOf')})"""
_BOOLEAN = ["owl:intersectionOf", "owl:unionOf", "owl:complementOf"]
on_triples("h25_value", populate.has_values, _ON_PROPERTY + f" SELECT s AS id, property, o AS v FROM t LEFT JOIN prop ON prop.id = s WHERE p = {_q('owl:hasValue')}", [*_RESTRICTIONS, "owl:hasValue"])
_QUANT_SQL = f" SELECT s AS id, CASE p WHEN {_q('owl:someValuesFrom')} THEN 'some' ELSE 'only' END AS quantifier, property, o AS filler FROM t LEFT JOIN prop ON prop.id = s WHERE p IN {_in('owl:someValuesFrom', 'owl:allValuesFrom')}"
on_triples("h26_quantifier", populate.quantifiers, _ON_PROPERTY + _QUANT_SQL, [*_RESTRICTIONS, "owl:someValuesFrom", "owl:allValuesFrom"])
on_triples("h30_containers", populate.containers, f" SELECT s AS container, CAST(regexp_extract(p, '_(\\d+)$', 1) AS BIGINT) AS pos, o AS member FROM t WHERE starts_with(p, {_q('rdf:_')}) AND s IN (SELECT s FROM t WHERE p = {_q('rdf:type')} AND o IN {_in('rdf:Bag', 'rdf:Alt', 'rdf:Seq')})")
on_triples("h32_swrl_rules", lambda t: populate.swrl_rules(t, closure.list_items(t)), ITEMS + f""", sides AS (SELECT s AS rule, regexp_extract(p, '#(.*)$', 1) AS side, idx AS pos, item FROM t JOIN items ON head = o WHERE p IN {_in('swrl:body', 'swrl:head')})
SELECT rule, side, pos, item AS atom, (SELECT min(o) FROM t WHERE s = item AND p IN {_in('swrl:classPredicate', 'swrl:propertyPredicate', 'swrl:builtin', 'swrl:dataRange')}) AS predicate, (SELECT string_agg(o, ',' ORDER BY p) FROM t WHERE s = item AND p IN {_in('swrl:argument1', 'swrl:argument2')}) AS args FROM sides""", ["rdf:type", "swrl:body", "swrl:head", "swrl:classPredicate", "swrl:propertyPredicate", "swrl:argument1", "swrl:argument2", *LISTS])

# ------------------------------------------------------------------ axioms, closures, inheritance

for _name, _type, _p in (("g2_pairwise_disjoint", "owl:AllDisjointClasses", "owl:members"), ("g3_all_different", "owl:AllDifferent", "owl:distinctMembers"), ("g4_disjoint_properties", "owl:AllDisjointProperties", "owl:members")):
    on_triples(_name, lambda t, ty=_type, p=_p: axioms.pairwise(t, closure.list_items(t), ty, p), ITEMS + f", m AS (SELECT s, idx, item FROM t JOIN items ON head = o WHERE p = {_q(_p)} AND s IN (SELECT s FROM t WHERE p = {_q('rdf:type')} AND o = {_q(_type)})), x AS (SELECT a.item AS a, b.item AS b FROM m a JOIN m b ON a.s = b.s AND a.idx < b.idx AND a.item <> b.item) SELECT a, b FROM x UNION SELECT b, a FROM x", ["rdf:type", _p, *LISTS])
_SIDES_SQL = _reach("rdfs:subPropertyOf") + f""",
props AS (SELECT s AS id, CASE min(CASE o WHEN {_q('owl:ObjectProperty')} THEN 0 WHEN {_q('owl:DatatypeProperty')} THEN 1 ELSE 2 END) WHEN 0 THEN 'Relation' WHEN 1 THEN 'Attribute' ELSE 'Annotation' END AS cls FROM t WHERE p = {_q('rdf:type')} AND o IN {_in('owl:ObjectProperty', 'owl:DatatypeProperty', 'owl:AnnotationProperty')} GROUP BY s),
decl AS (SELECT DISTINCT s AS id, CASE p WHEN {_q('rdfs:domain')} THEN 'domain' ELSE 'range' END AS side, o AS value FROM t WHERE p IN {_in('rdfs:domain', 'rdfs:range')} AND o_kind = 'iri'),
iv AS (SELECT s AS a, o AS b FROM t WHERE p = {_q('owl:inverseOf')} AND s <> o UNION SELECT o, s FROM t WHERE p = {_q('owl:inverseOf')} AND s <> o),
byinv AS (SELECT a AS id, CASE side WHEN 'domain' THEN 'range' ELSE 'domain' END AS side, min(value) AS value FROM iv JOIN decl ON decl.id = b WHERE value <> {_q('owl:Thing')} GROUP BY ALL),
own AS (SELECT id, side, min(value) AS value FROM decl GROUP BY id, side),
above AS (SELECT * FROM own UNION ALL SELECT * FROM byinv WHERE (id, side) NOT IN (SELECT (id, side) FROM own)),
upr AS (SELECT a AS id, side, arg_min(value, (depth, value)) AS value FROM reach JOIN above ON above.id = b GROUP BY ALL),
upa AS (SELECT a AS id, side, arg_min(value, (depth, value)) AS value FROM reach JOIN own ON own.id = b GROUP BY ALL),"""
_SIDES_OWL = _SIDES_SQL + f"""
need AS (SELECT id, cls, side FROM props, (VALUES ('domain'), ('range')) v(side) WHERE (id, side) NOT IN (SELECT (id, side) FROM decl)),
got AS (
  SELECT n.id AS prop, n.side, CASE WHEN cls <> 'Attribute' THEN coalesce(i.value, r.value) ELSE a.value END AS found,
    CASE WHEN cls <> 'Attribute' AND i.value IS NOT NULL THEN 'inverse' ELSE 'ancestor' END AS how,
    CASE WHEN cls = 'Attribute' AND n.side = 'range' THEN {_q('rdfs:Literal')} WHEN cls IN ('Relation', 'Attribute') THEN {_q('owl:Thing')} END AS dflt
  FROM need n LEFT JOIN byinv i ON (i.id, i.side) = (n.id, n.side) LEFT JOIN upr r ON (r.id, r.side) = (n.id, n.side) LEFT JOIN upa a ON (a.id, a.side) = (n.id, n.side)),
sides AS (
  SELECT d.id AS prop, side, value, 'declared' AS source FROM decl d JOIN props ON props.id = d.id
  UNION ALL SELECT prop, side, coalesce(found, dflt), CASE WHEN found IS NULL THEN 'default' ELSE how END FROM got WHERE coalesce(found, dflt) IS NOT NULL)"""
_SIDE_PREDICATES = ["rdf:type", "rdfs:domain", "rdfs:range", "owl:inverseOf", "rdfs:subPropertyOf"]


def _sides(t: DataFrame) -> DataFrame:
    t = t.where("s_kind = 'iri'")
    return axioms.domains_and_ranges(t, axioms.typed_properties(t))


on_triples("g5_defaults", lambda t: _sides(t).where("source = 'default'"), _SIDES_OWL.replace("FROM t ", "FROM (SELECT * FROM t WHERE s_kind = 'iri') t ") + " SELECT * FROM sides WHERE source = 'default'", _SIDE_PREDICATES, shared=True)
on_triples("g6_inheritance", lambda t: _sides(t).where("source <> 'default'"), _SIDES_OWL.replace("FROM t ", "FROM (SELECT * FROM t WHERE s_kind = 'iri') t ") + " SELECT * FROM sides WHERE source <> 'default'", _SIDE_PREDICATES, shared=True)
on_triples("g7_rdfs_defaults", lambda t: axioms.domains_and_ranges(t.where("s_kind = 'iri'"), patterns.match(t, p="rdf:type", o="rdf:Property").select(F.col("s").alias("id"), F.lit("Property").alias("cls")), "rdf"), _SIDES_SQL.replace("FROM t ", "FROM (SELECT * FROM t WHERE s_kind = 'iri') t ") + f"""
gp AS (SELECT DISTINCT s AS id FROM t WHERE p = {_q('rdf:type')} AND o = {_q('rdf:Property')}),
need AS (SELECT id, side FROM gp, (VALUES ('domain'), ('range')) v(side) WHERE (id, side) NOT IN (SELECT (id, side) FROM decl))
SELECT d.id AS prop, side, value, 'declared' AS source FROM decl d JOIN gp ON gp.id = d.id
UNION ALL SELECT n.id, n.side, coalesce(value, CASE n.side WHEN 'domain' THEN {_q('rdfs:Resource')} ELSE {_q('rdfs:Class')} END), CASE WHEN value IS NULL THEN 'default' ELSE 'ancestor' END FROM need n LEFT JOIN upa a ON (a.id, a.side) = (n.id, n.side)""", _SIDE_PREDICATES, shared=True)
on_triples("g5_default_types", lambda t: axioms.default_types(t, patterns.match(t, p="rdf:type", o="owl:NamedIndividual").select(F.col("s").alias("id"))), f" SELECT DISTINCT s AS id, {_q('owl:Thing')} AS type FROM t WHERE p = {_q('rdf:type')} AND o = {_q('owl:NamedIndividual')} AND s NOT IN (SELECT s FROM t WHERE p = {_q('rdf:type')} AND NOT ({_STRUCTURAL}))", ["rdf:type"])
on_triples("g9_ancestors", lambda t: closure.closure(patterns.match(t, p="rdfs:subClassOf").where("o_kind = 'iri'").select(F.col("s").alias("a"), F.col("o").alias("b"))).select(F.col("a").alias("node"), F.col("b").alias("ancestor"), "depth"), _reach("rdfs:subClassOf").replace("AND s <> o", "AND s <> o AND o_kind = 'iri'") + " SELECT a AS node, b AS ancestor, depth FROM reach", ["rdfs:subClassOf"])
_TREE = ["rdfs:subClassOf", "rdf:type"]


def _typed(t: DataFrame, *types: str) -> DataFrame:
    return patterns.match(t, p="rdf:type").where(F.col("o").isin([iri(x) for x in types])).select(F.col("s").alias("id")).distinct()


def _class_links(t: DataFrame) -> DataFrame:
    return patterns.match(t, p="rdfs:subClassOf").where("o_kind = 'iri'").select(F.col("s").alias("a"), F.col("o").alias("b"))


def _nearest_sql(start: str, mark: str, steps: str) -> str:
    """The nearest marked node of each start, the smallest of several; a search from the starts alone."""
    typed = lambda x: f"SELECT s FROM t WHERE p = {_q('rdf:type')} AND o = {_q(x)}"
    return f""", up AS (SELECT DISTINCT s AS a, o AS b FROM t WHERE p = {_q('rdfs:subClassOf')} AND o_kind = 'iri' AND s <> o), steps AS MATERIALIZED ({steps}),
ways AS (SELECT DISTINCT s AS id, s AS node, 0 AS depth FROM t WHERE s IN ({typed(start)}) UNION SELECT id, b, depth + 1 FROM ways JOIN steps ON a = node WHERE depth < 40),
hits AS (SELECT id, node, min(depth) AS depth FROM ways WHERE node <> id AND node IN ({typed(mark)}) GROUP BY id, node)
SELECT id, arg_min(node, (depth, node)) AS nearest, CAST(min(depth) AS BIGINT) AS depth FROM hits GROUP BY id"""


def _nearest(t: DataFrame, start: str, mark: str, direction: str) -> DataFrame:
    return closure.search(_class_links(t), _typed(t, start), _typed(t, mark).withColumn("nearest", F.col("id")), "nearest", direction)


on_triples("g9_nearest_above", lambda t: _nearest(t, "rdfs:Datatype", "owl:DeprecatedClass", "up"), _nearest_sql("rdfs:Datatype", "owl:DeprecatedClass", "SELECT a, b FROM up"), _TREE, shared=True)
on_triples("g9_nearest_below", lambda t: _nearest(t, "owl:DeprecatedClass", "owl:DeprecatedClass", "down"), _nearest_sql("owl:DeprecatedClass", "owl:DeprecatedClass", "SELECT b AS a, a AS b FROM up"), _TREE, shared=True)
on_triples("g9_nearest_around", lambda t: _nearest(t, "owl:DeprecatedClass", "rdfs:Datatype", "both"), _nearest_sql("owl:DeprecatedClass", "rdfs:Datatype", "SELECT a, b FROM up UNION SELECT b, a FROM up"), _TREE, shared=True)
on_triples("g9_descendants", lambda t: closure.closure(patterns.match(t, p="rdfs:subPropertyOf").select(F.col("s").alias("a"), F.col("o").alias("b"))).groupBy(F.col("b").alias("node")).agg(F.count("*").alias("n"), F.max("depth").alias("height")), _reach("rdfs:subPropertyOf") + " SELECT b AS node, count(*) AS n, max(depth) AS height FROM reach GROUP BY b", ["rdfs:subPropertyOf"])

# ------------------------------------------------------------------ statements and provenance


#: Predicates behind which lists fill something in.
OF_LISTS = [*values.LISTED, *retract.BOOLEAN, "owl:withRestrictions", "owl:disjointUnionOf", "owl:members", "owl:distinctMembers", "swrl:body", "swrl:head", "swrl:arguments"]


def _lists_of(t: DataFrame, *predicates: str) -> DataFrame:
    """The lists behind the predicates."""
    return closure.list_items(t, patterns.with_predicates(t, *predicates).select(F.col("o").alias("head")))


def _lists_of_nodes(t: DataFrame) -> DataFrame:
    """The lists that blank nodes point at."""
    return closure.list_items(t, t.where("s_kind = 'bnode' and o_kind <> 'literal'").where(~statements.is_cell()).select(F.col("o").alias("head")))


def _with_entities(run: Callable[[DataFrame, DataFrame, DataFrame], DataFrame], lists: Callable[[DataFrame], DataFrame] = lambda t: _lists_of(t, *OF_LISTS)) -> Callable[[DataFrame], DataFrame]:
    """``run`` gets the triples, those of their lists that it asks for, and their entities, both written once."""
    return lambda t: run(t, closure.materialize(lists(t)), closure.materialize(classify.entities(t)))


def _fates(t: DataFrame, found: DataFrame) -> DataFrame:
    """p with the number of its triples that fill something in, of those that become statements, and of those that do both."""
    found = closure.materialize(found)
    own = t.where(F.col("p") != iri("rdf:type")).select(*statements.TRIPLE).distinct()
    filling = values.scoped(t, found).select(*statements.TRIPLE).distinct().withColumn("a", F.lit(1))
    made = statements.statements(t, found).withColumn("b", F.lit(1))
    both = own.join(filling, statements.TRIPLE, "left").join(made, statements.TRIPLE, "left")
    return both.groupBy("p").agg(F.count("a").alias("n_values"), F.count("b").alias("n_statements"), F.count(F.col("a") + F.col("b")).alias("n_both"))


_CONSUMED = f""",
used AS (
  SELECT DISTINCT t.s, t.p, t.o, t.o_lang FROM t LEFT JOIN pr ON pr.p = t.p JOIN ent e ON e.id = t.s JOIN main m ON m.id = t.s
  WHERE CASE WHEN t.p LIKE '%#%' THEN regexp_extract(t.p, '^(.*#)', 1) ELSE regexp_extract(t.p, '^(.*/)', 1) END IN ({', '.join(repr(x) for x in R.namespaces('owl'))})
    AND (t.o IN (SELECT s FROM t WHERE p = {_q('rdf:first')}) OR (coalesce(pr.acts, false) AND pr.handler <> 'property_chain'))
    AND (pr.p IS NULL OR len(list_filter(pr.targets, lambda x: list_contains({PAIRS}, e.cls || '<' || x))) > 0)
    AND (e.cls = m.main OR list_contains(coalesce(pr.targets, CAST([] AS VARCHAR[])), e.cls))
  UNION SELECT s, p, o, o_lang FROM t WHERE starts_with(p, {_q('rdf:_')}) AND s IN (SELECT s FROM t WHERE p = {_q('rdf:type')} AND o IN {_in('rdf:Bag', 'rdf:Alt', 'rdf:Seq')})),
structured AS (
  SELECT DISTINCT s FROM t WHERE s_kind = 'bnode' AND s NOT IN (SELECT id FROM ent) AND s NOT IN (SELECT s FROM t WHERE p = {_q('rdf:type')} AND o IN (SELECT o FROM tr)) AND s NOT IN (SELECT s FROM t WHERE p IN {_in('rdf:first', 'rdf:rest')})),
stmts AS (
  SELECT s, p, o, o_lang FROM t WHERE p NOT IN {_in(*STRUCTURAL_PREDICATES, 'rdf:type')} AND s NOT IN (SELECT s FROM structured)
    AND NOT (({' OR '.join(f"starts_with(s, '{x}')" for x in R.namespaces('owl'))}) AND s NOT IN (SELECT s FROM t WHERE p = {_q('rdf:type')}))
  EXCEPT SELECT * FROM used)"""
on_triples("s1_statements", lambda t: statements.statements(t, closure.materialize(classify.entities(t))), ENTITIES + _CONSUMED + " SELECT s, p, o, o_lang FROM stmts")
on_triples("s6_nested_statements", lambda t: statements.nested_statements(t, closure.materialize(classify.entities(t))), ENTITIES + _CONSUMED + " SELECT s AS id, arg_min(p, (p, o)) AS predicate, arg_min(o, (p, o)) AS object, count(*) - 1 AS n_sides FROM t WHERE s IN (SELECT s FROM structured) AND p NOT IN " + _in(*STRUCTURAL_PREDICATES, "rdf:type", *FACETS) + f" AND NOT (p = {_q('owl:inverseOf')} AND s IN (SELECT o FROM t WHERE p = {_q('owl:onProperty')})) GROUP BY s")
on_triples(
    "tp5_value_or_statement", lambda t: _fates(t, classify.entities(t)),
    ENTITIES + _CONSUMED + f""", sc AS (SELECT * FROM used UNION SELECT s, p, o, o_lang FROM t WHERE s IN (SELECT s FROM structured)),
fate AS (SELECT DISTINCT s, p, o, o_lang, (s, p, o, o_lang) IN (SELECT (s, p, o, o_lang) FROM sc) AS a, (s, p, o, o_lang) IN (SELECT (s, p, o, o_lang) FROM stmts) AS b FROM t WHERE p <> {_q('rdf:type')})
SELECT p, count(*) FILTER (a) AS n_values, count(*) FILTER (b) AS n_statements, count(*) FILTER (a AND b) AS n_both FROM fate GROUP BY p""",
)
on_triples("h29_statement_containers", lambda t: statements.list_objects(statements.statements(t, closure.materialize(classify.entities(t))), closure.materialize(closure.list_items(t))), ENTITIES + ITEMS + _CONSUMED + " SELECT DISTINCT head AS id, idx, item FROM stmts JOIN items ON head = o")
_LOCAL = "regexp_extract({0}, '([^/#]*)$', 1)"
_NESTED_SQL = f""",
own AS (SELECT DISTINCT s AS id, p, o, o_lang, o_kind FROM t WHERE s IN (SELECT s FROM structured) AND p NOT IN {_in(*STRUCTURAL_PREDICATES, 'rdf:type', *FACETS)} AND NOT (p = {_q('owl:inverseOf')} AND s IN (SELECT o FROM t WHERE p = {_q('owl:onProperty')}))),
slots AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p, o, o_lang) = 1 AS is_main FROM own),
parts AS MATERIALIZED (
  SELECT id, CASE WHEN is_main THEN 'has_object' ELSE {_LOCAL.format('p')} END AS attr,
    CASE WHEN is_main THEN 0 ELSE row_number() OVER (PARTITION BY id, is_main, {_LOCAL.format('p')} ORDER BY p, o, o_lang) END AS pos, p, o,
    CASE WHEN o_kind = 'literal' THEN 'literal' WHEN o IN (SELECT head FROM items) THEN 'container' WHEN o IN (SELECT s FROM structured) THEN 'statement' ELSE 'entity' END AS kind
  FROM slots)"""
on_triples("s6_nested_parts", _with_entities(lambda t, items, found: statements.nested_parts(t, found, items), _lists_of_nodes), ENTITIES + ITEMS + _CONSUMED + _NESTED_SQL + " SELECT id, attr, pos, p, o, kind FROM parts")
on_triples("s6_nested_values", _with_entities(lambda t, items, found: statements.nested_values(statements.nested_parts(t, found, items)), _lists_of_nodes), ENTITIES + ITEMS + _CONSUMED + _NESTED_SQL + """,
ways AS (
  SELECT id, o AS node, attr || pos AS path, kind, 1 AS depth FROM parts
  UNION ALL SELECT w.id, x.o, w.path || '/' || x.attr || x.pos, x.kind, depth + 1 FROM ways w JOIN parts x ON x.id = w.node WHERE w.kind = 'statement' AND depth < 20)
SELECT id, path, node AS v, kind FROM ways WHERE kind <> 'statement'""")
_VOCABULARY = " OR ".join("starts_with({0}, '" + PREFIXES[x] + "')" for x in ("rdf", "rdfs", "owl", "skos", "xsd"))
on_triples("s2_made_entities", _with_entities(lambda t, items, found: statements.made_entities(t, found, closure.materialize(statements.left_over(t, found)), closure.materialize(statements.nested_parts(t, found, items))), _lists_of_nodes), ENTITIES + ITEMS + _CONSUMED + _NESTED_SQL + f""",
st AS MATERIALIZED (SELECT DISTINCT s, s_kind, p, o, o_kind FROM t WHERE (s, p, o, o_lang) IN (SELECT (s, p, o, o_lang) FROM stmts)),
heads AS (SELECT DISTINCT s AS id FROM t WHERE p = {_q('rdf:first')}),
preds AS (SELECT p AS id FROM st UNION SELECT p FROM parts EXCEPT SELECT id FROM ent WHERE cls IN ({', '.join(f"'{c}'" for c in R.below('Property'))})),
ends AS (
  SELECT s AS id, s_kind AS id_kind, CASE WHEN {_VOCABULARY.format('s')} THEN 'Resource' ELSE 'Individual' END AS cls FROM st
  UNION SELECT o, o_kind, 'Resource' FROM st WHERE o_kind <> 'literal' AND NOT ({_VOCABULARY.format('o')})
  UNION SELECT o, CASE WHEN starts_with(o, '_:') THEN 'bnode' ELSE 'iri' END, 'Individual' FROM parts WHERE kind = 'entity' AND NOT ({_VOCABULARY.format('o')}))
SELECT id, 'iri' AS id_kind, 'Annotation' AS cls FROM preds
UNION ALL SELECT id, id_kind, min(cls) FROM ends WHERE id NOT IN (SELECT id FROM ent) AND id NOT IN (SELECT id FROM heads) AND id NOT IN (SELECT id FROM parts) AND id NOT IN (SELECT id FROM preds) GROUP BY id, id_kind
UNION ALL SELECT DISTINCT id, 'bnode', 'Statement' FROM parts
UNION ALL SELECT DISTINCT o, 'bnode', 'Container' FROM (SELECT o FROM st WHERE o_kind = 'bnode' UNION SELECT o FROM parts WHERE kind = 'container') WHERE o IN (SELECT id FROM heads) AND o NOT IN (SELECT id FROM ent)""")
_REIFIED_SQL = ", " + _values("rk", "o, kind", [(iri(k), k) for k in statements.REIFIED]) + ", " + _values("rl", "kind, p, slot", [(k, iri(p), slot) for k, (s_, p_, os_) in statements.REIFIED.items() for slot, ps in (("s", [s_]), ("p", [p_]), ("o", os_)) for p in ps]) + f""",
about AS (
  SELECT t.s AS id, kind, min(t.o) FILTER (slot = 's') AS s, min(t.o) FILTER (slot = 'p') AS p, min((t.o, t.o_lang)) FILTER (slot = 'o') AS m, kind <> 'owl:NegativePropertyAssertion' AS is_positive
  FROM t JOIN rl USING (p) WHERE (t.s, kind) IN (SELECT (t.s, kind) FROM t JOIN rk USING (o) WHERE p = {_q('rdf:type')}) GROUP BY t.s, kind)"""
on_triples("s10_reified", statements.reified, _REIFIED_SQL + " SELECT id, kind, s, p, m[1] AS o, m[2] AS o_lang, is_positive, (s, p, m[1]) IN (SELECT (s, p, o) FROM t) AS is_asserted FROM about WHERE s IS NOT NULL AND p IS NOT NULL AND m IS NOT NULL", shared=True)
on_triples("s10_triple_annotations", statements.triple_annotations, _REIFIED_SQL + f" SELECT DISTINCT a.s, a.p, m[1] AS o, t.p AS attr, t.o AS v, t.o_lang AS v_lang, is_positive FROM about a JOIN t ON t.s = a.id WHERE a.s IS NOT NULL AND a.p IS NOT NULL AND m IS NOT NULL AND t.p <> {_q('rdf:type')} AND t.p NOT IN (SELECT p FROM rl)", shared=True)
_BNODES = """, nodes AS (SELECT s AS root, o AS node FROM t WHERE s_kind = 'iri' AND o_kind = 'bnode' UNION SELECT n.root, t.o FROM nodes n JOIN t ON t.s = n.node AND t.o_kind = 'bnode'),
inner_ AS (SELECT DISTINCT root, s, p, o FROM nodes JOIN t ON s = node)"""
on_triples("s8_bnode_closure", statements.bnode_closure, _BNODES + " SELECT * FROM inner_", shared=True)
on_triples("s7_provenance", lambda t: statements.provenance(t, populate.list_values(t, _lists_of(t, "owl:members", "owl:distinctMembers"), "owl:members", "owl:distinctMembers")).groupBy("root").agg(F.count("*").alias("n"), F.min("s").alias("first")), ITEMS + _BNODES + f""", parts AS (
  SELECT s AS root, s, p, o FROM t WHERE s_kind = 'iri' UNION SELECT * FROM inner_
  UNION SELECT item, y.s, y.p, y.o FROM t x JOIN items ON head = x.o JOIN t y ON y.s = x.s WHERE x.p IN {_in('owl:members', 'owl:distinctMembers')})
SELECT root, count(*) AS n, min(s) AS first FROM parts GROUP BY root""")

# ------------------------------------------------------------------ truth functions and what is taken back

#: More rounds than restrictions, complements and lists are nested in the lifted data.
_ROUNDS = 6
_GONE_SQL = ENTITIES + ITEMS + f""",
tf AS (
  SELECT DISTINCT s AS owner, CASE p WHEN {_q('owl:intersectionOf')} THEN 'and' WHEN {_q('owl:unionOf')} THEN 'or' ELSE 'not' END AS operator, o AS head, own,
    CASE WHEN own THEN s WHEN p = {_q('owl:complementOf')} THEN '_:n' || substr(sha256(s || chr(10) || o), 1, 32) ELSE o END AS node
  FROM t JOIN (SELECT id, bool_or(cls = 'TruthFunction') AS own FROM ent WHERE cls IN ('TruthFunction', 'Concept') GROUP BY id) ON id = s
  WHERE o_kind <> 'literal' AND p IN {_in(*retract.BOOLEAN, 'owl:complementOf')}),
ops AS (SELECT node, idx, item FROM tf JOIN items USING (head) WHERE operator <> 'not' UNION SELECT node, 0, head FROM tf WHERE operator = 'not'),
single AS (SELECT DISTINCT s AS node, o AS item FROM t WHERE o_kind = 'bnode' AND p IN {_in(*retract.NEEDED)} AND s IN (SELECT id FROM ent WHERE id_kind = 'bnode' AND cls IN ({', '.join(f"'{c}'" for c in R.below('Restriction'))}))),
g0 AS (SELECT id FROM ent WHERE id_kind = 'bnode' AND cls IN ({', '.join(f"'{c}'" for c in R.below('PropertyConceptRestriction'))}) AND id NOT IN (SELECT s FROM t WHERE p = {_q('owl:onProperty')}))""" + "".join(f""",
g{k} AS (SELECT id FROM g{k - 1} UNION SELECT node FROM single JOIN g{k - 1} ON item = id UNION SELECT node FROM ops LEFT JOIN g{k - 1} ON item = id GROUP BY node HAVING count(*) = count(id))""" for k in range(1, _ROUNDS + 1)) + f""",
gone AS MATERIALIZED (SELECT id FROM g{_ROUNDS})"""
_TRUTH_VALUES_SQL = """,
stay AS (SELECT * FROM ops WHERE item NOT IN (SELECT id FROM gone)),
live AS (
  SELECT tf.*, lone, NOT own AND operator <> 'not' AND n = 1 AS alone FROM tf JOIN (SELECT node, count(*) AS n, min(item) AS lone FROM stay GROUP BY node) USING (node)
  WHERE owner NOT IN (SELECT id FROM gone) AND node NOT IN (SELECT id FROM gone)),
tv AS (
  SELECT node AS id, 'has_logical_operator' AS attr, 0 AS ord, operator AS v FROM live WHERE NOT alone
  UNION SELECT node, 'applies_on_concept', idx, item FROM stay WHERE node IN (SELECT node FROM live WHERE NOT alone)
  UNION SELECT owner, 'is_equivalent_to', 0, lone FROM live WHERE alone
  UNION SELECT owner, 'is_equivalent_to', 0, node FROM live WHERE NOT alone AND NOT own)"""


on_triples("h20_truth", _with_entities(lambda t, items, found: retract.truth_values(t, items, found, retract.retracted(t, items, found))), _GONE_SQL + _TRUTH_VALUES_SQL + " SELECT id, attr, ord, v FROM tv")
on_triples("w04_retracted", _with_entities(lambda t, items, found: retract.retracted(t, items, found).select("id", (F.col("round") > 0).alias("follows"))), _GONE_SQL + " SELECT id, id NOT IN (SELECT id FROM g0) AS follows FROM gone")
on_triples("w04_missing_on_property", lambda t: quality.missing_properties(t, closure.materialize(classify.entities(t))), ENTITIES + f""", onp AS (SELECT s, bool_or(o_kind <> 'literal') AS resolved FROM t WHERE p = {_q('owl:onProperty')} GROUP BY s)
SELECT DISTINCT 'missing_on_property' AS code, id AS subject, cls || ' has owl:onProperty but applies_on_property is None' AS message FROM ent LEFT JOIN onp ON s = id WHERE cls IN ({', '.join(f"'{c}'" for c in R.below('PropertyConceptRestriction'))}) AND NOT coalesce(resolved, false) AND (id_kind = 'iri' OR resolved IS NOT NULL)""")

# ------------------------------------------------------------------ warnings

_FILLERS = _in(*quality.FILLERS)
on_triples("w01_malformed_restriction", quality.malformed_restrictions, f""", k AS (SELECT DISTINCT s, p FROM t WHERE s_kind = 'bnode' AND p IN {_FILLERS}), sev AS (SELECT s FROM k GROUP BY s HAVING count(*) > 1),
par AS (SELECT o AS s, min(s) AS parent FROM t WHERE s_kind = 'iri' AND o_kind = 'bnode' GROUP BY o),
per AS (SELECT coalesce(parent, '<anonymous>') AS subject, list_sort(list(DISTINCT 'owl:' || regexp_extract(p, '([^/#]*)$', 1))) AS names FROM k JOIN sev USING (s) LEFT JOIN par USING (s) GROUP BY ALL)
SELECT 'malformed_restriction' AS code, subject, 'OWL 2 DL: malformed restrictions on ' || subject || ' (' || array_to_string(names, ', ') || ')' AS message FROM per""".replace("GROUP BY ALL)\nSELECT", "GROUP BY 1)\nSELECT"))
on_triples("w02_empty_truth_function", lambda t: quality.small_truth_functions(t, closure.list_items(t), 0), ITEMS + _TRUTH_SQL + " SELECT 'empty_truth_function' AS code, id AS subject, '§8.1.1: Truth Function (' || id || ', ' || operator || ') is empty — ignored (collection BNode: ' || id || ')' AS message FROM truth WHERE n = 0 AND operator <> 'not'", [*_BOOLEAN, *LISTS])
on_triples("w03_singleton_truth_function", lambda t: quality.small_truth_functions(t, closure.list_items(t), 1), ITEMS + _TRUTH_SQL + " SELECT 'singleton_truth_function' AS code, id AS subject, '§8.1.1: TruthFunction (' || id || ', ' || operator || ') has a single element — ontology should be checked (collection BNode: ' || id || ')' AS message FROM truth WHERE n = 1 AND operator <> 'not'", [*_BOOLEAN, *LISTS])
on_triples("w04_orphan_restriction", quality.orphan_restrictions, f" SELECT 'orphan_restriction' AS code, s AS subject, 'Orphan ' || CASE WHEN bool_or(p IN {_in('owl:someValuesFrom', 'owl:allValuesFrom')}) THEN 'Quantifier' ELSE 'Cardinality' END || ': no owl:onProperty in graph, removed' AS message FROM t WHERE s_kind = 'bnode' AND p IN {_FILLERS} AND s NOT IN (SELECT s FROM t WHERE p = {_q('owl:onProperty')}) GROUP BY s")
on_triples("w05_multiple_inverse_of", quality.multiple_inverses, f", e AS (SELECT s AS a, o AS b FROM t WHERE p = {_q('owl:inverseOf')} AND s_kind = 'iri' AND o_kind = 'iri'), x AS (SELECT a, b FROM e UNION SELECT b, a FROM e) SELECT 'multiple_inverse_of' AS code, a AS subject, '§9.2.4: Relation ' || a || ' has ' || count(*) || ' owl:inverseOf declarations (' || string_agg(b, ', ' ORDER BY b) || ')' AS message FROM x GROUP BY a HAVING count(*) > 1", ["owl:inverseOf"])
on_triples("w06_empty_restriction", lambda t: quality.empty_restrictions(t, closure.list_items(t)), ITEMS + _TRUTH_SQL + " SELECT 'empty_restriction' AS code, id AS subject, 'TruthFunction has empty applies_on_concept' AS message FROM truth WHERE n = 0", [*_BOOLEAN, *LISTS])


def _hierarchy_sql(p: str, classes: tuple, code: str, word: str) -> str:
    return ENTITIES + f" SELECT DISTINCT '{code}' AS code, s AS subject, '§5.8.1: ' || c.cls || ' ' || s || ' {word} ' || d.cls || ' ' || o AS message FROM t JOIN ent c ON c.id = s JOIN ent d ON d.id = o WHERE p = {_q(p)} AND s_kind = 'iri' AND o_kind = 'iri' AND c.cls IN {classes} AND d.cls IN {classes} AND NOT list_contains({PAIRS}, d.cls || '<' || c.cls)"


on_triples("w07_property_hierarchy", lambda t: quality.property_hierarchy(t, classify.entities(t)), _hierarchy_sql("rdfs:subPropertyOf", ("Relation", "Attribute", "Annotation"), "property_type_mismatch_hierarchy", "subPropertyOf"))
on_triples("w08_class_hierarchy", lambda t: quality.class_hierarchy(t, classify.entities(t)), _hierarchy_sql("rdfs:subClassOf", ("Concept", "Datatype"), "class_datatype_mismatch_hierarchy", "subClassOf"))
on_triples("w09_punning_conflicts", lambda t: quality.punning_conflicts(classify.entities(t)), ENTITIES + """, per AS (SELECT id, list_sort(list(DISTINCT cls)) AS l FROM ent WHERE id_kind = 'iri' GROUP BY id)
SELECT 'class_datatype_conflict' AS code, id AS subject, '§5.8.1: ' || id || ' has both Concept and Datatype in cache' AS message FROM per WHERE list_contains(l, 'Concept') AND list_contains(l, 'Datatype')
UNION ALL SELECT 'property_type_conflict', id, '§5.8.1: ' || id || ' has multiple property types: [''' || array_to_string(k, ''', ''') || ''']' FROM (SELECT id, list_filter(l, lambda c: c IN ('Annotation', 'Attribute', 'Relation')) AS k FROM per) WHERE len(k) > 1""")
on_triples("w10_config_type_mismatch", lambda t: quality.config_mismatches(t, classify.entities(t)), ENTITIES + f""", per AS (SELECT id, list_sort(list(DISTINCT cls)) AS l FROM ent GROUP BY id)
SELECT DISTINCT 'config_type_mismatch' AS code, s AS subject, s || ' subject of ' || t.p || ' (expected [''' || array_to_string(targets, ''', ''') || ''']) got [''' || array_to_string(l, ''', ''') || ''']' AS message
FROM t JOIN pr ON pr.p = t.p JOIN per ON id = s WHERE s_kind = 'iri' AND len(list_filter(l, lambda c: len(list_filter(targets, lambda x: list_contains({PAIRS}, c || '<' || x))) > 0)) = 0""")

# ------------------------------------------------------------------ views

_CLEAN = "trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_extract({0}, '([^/#]*)$', 1), '^(get_has_|get_|has_)', ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_', ' '), ' +', ' ', 'g'))"


def _labels_sql(lang: str) -> str:
    return f", best AS (SELECT s AS id, arg_min(o, (CASE WHEN starts_with(lower(o_lang), '{lang}') THEN CASE WHEN p = {_q('skos:prefLabel')} THEN 0 ELSE 1 END WHEN p = {_q('skos:prefLabel')} THEN 2 ELSE 3 END, o_lang, o)) AS label FROM t WHERE p IN {_in('skos:prefLabel', 'rdfs:label')} AND o_kind = 'literal' GROUP BY s)"


_LABELLED = ["skos:prefLabel", "rdfs:label", "rdfs:subClassOf"]
for _lang in ("en", "fr"):
    on_triples(f"v1_best_label_{_lang}", lambda t, lang=_lang: views.best_labels(t, t.where("s_kind = 'iri'").select(F.col("s").alias("id")), lang), _labels_sql(_lang) + f" SELECT DISTINCT s AS id, coalesce(label, {_CLEAN.format('s')}) AS label FROM t LEFT JOIN best ON best.id = s WHERE s_kind = 'iri'", _LABELLED)
on_triples("v5_sections", lambda t: views.section_counts(classify.entities(t)), ENTITIES + f" SELECT cls AS section, count(*) AS n FROM ent WHERE cls IN {tuple(views.SECTIONS['owl'])} GROUP BY cls")
on_triples("v6_entities", lambda t: views.entity_cards(t, classify.entities(t)), ENTITIES + _labels_sql("en") + f" SELECT 'id_' || md5(id) || '_' || cls AS anchor_id, cls, id AS uri, coalesce(label, {_CLEAN.format('id')}) AS label, id IN (SELECT s FROM t WHERE p = {_q('owl:deprecated')} OR (p = {_q('rdf:type')} AND o = {_q('owl:DeprecatedClass')})) AS is_deprecated FROM ent LEFT JOIN best USING (id) WHERE cls <> 'Literal'")
on_triples("v7_metadata", views.ontology_metadata, f" SELECT DISTINCT {_CLEAN.format('p')} AS attr, o AS v FROM t WHERE p <> {_q('rdf:type')} AND s = (SELECT min(s) FROM t WHERE p = {_q('rdf:type')} AND o IN {_in('owl:Ontology', 'skos:ConceptScheme')})")
_SHORT = "CASE WHEN {0} LIKE '%/%' OR {0} LIKE '%#%' THEN regexp_extract({0}, '([^/#]*)$', 1) ELSE {0} END"
_TEXTS_SQL = ITEMS + _CARD_SQL + _TRUTH_SQL + f""", pn AS (SELECT restriction AS id, min((property, is_inverse)) AS m FROM onp GROUP BY restriction),
nm AS (SELECT id, CASE WHEN m[2] THEN 'inverse of ' ELSE '' END || {_SHORT.format('m[1]')} AS name FROM pn),
qt AS ({_QUANT_SQL}),
lst AS (SELECT s AS id, p, idx, item, max(idx) OVER (PARTITION BY s) AS last FROM t JOIN items ON head = o WHERE p IN {_in('owl:intersectionOf', 'owl:unionOf', 'owl:oneOf')}),
fc AS (SELECT n.s AS id, idx, {_FACETS.replace('CASE p', 'CASE f.p')} AS comparator, f.o AS v, (SELECT min(o) FROM t WHERE s = n.s AND p = {_q('owl:onDatatype')}) AS datatype FROM t n JOIN items ON head = n.o JOIN t f ON f.s = item AND f.p IN {_in(*FACETS)} WHERE n.p = {_q('owl:withRestrictions')}),
pt AS MATERIALIZED (SELECT * FROM (
  SELECT id, 0 AS n, coalesce(name, '') || ' ' || quantifier || ' ' AS before, filler AS part, '' AS after FROM qt LEFT JOIN nm USING (id)
  UNION ALL SELECT id, 0, coalesce(name, '') || ' ' || kind || ' ' || coalesce(CAST(n AS VARCHAR), ''), filler, '' FROM card LEFT JOIN nm USING (id) WHERE id NOT IN (SELECT id FROM qt)
  UNION ALL SELECT s, 0, coalesce(name, '') || ' value ', o, '' FROM t LEFT JOIN nm ON nm.id = s WHERE p = {_q('owl:hasValue')}
  UNION ALL SELECT id, idx, CASE WHEN idx = 1 THEN CASE WHEN p = {_q('owl:oneOf')} THEN 'one of {{ ' ELSE '(' END WHEN p = {_q('owl:intersectionOf')} THEN ' and ' WHEN p = {_q('owl:unionOf')} THEN ' or ' ELSE ', ' END, item, CASE WHEN idx = last THEN CASE WHEN p = {_q('owl:oneOf')} THEN ' }}' ELSE ')' END ELSE '' END FROM lst
  UNION ALL SELECT id, 0, '(', members, ')' FROM truth WHERE operator = 'not'
  UNION ALL SELECT id, idx, CASE WHEN idx = 1 THEN {_SHORT.format('datatype')} || ' restricted by ' ELSE ', ' END || comparator || ' ', v, '' FROM fc)
  WHERE starts_with(id, '_:')),
tx0 AS (SELECT CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS text WHERE false)""".replace("{{", "{").replace("}}", "}") + "".join(f""",
tx{k} AS (SELECT id, string_agg(txt, '' ORDER BY n, txt) AS text FROM (SELECT pt.id, n, before || coalesce(text, {_SHORT.format('part')}) || after AS txt FROM pt LEFT JOIN tx{k - 1} x ON x.id = part) GROUP BY id)""" for k in range(1, _ROUNDS + 1)) + f" SELECT id, text FROM tx{_ROUNDS}"
on_triples("v9_restriction_text", lambda t: views.restriction_texts(t, closure.materialize(_lists_of(t, *retract.BOOLEAN, "owl:oneOf", "owl:withRestrictions"))), _TEXTS_SQL)
on_triples("v10_chains", lambda t: views.chain_texts(populate.list_values(t, closure.list_items(t), "owl:propertyChainAxiom")), ITEMS + f" SELECT s AS owner, string_agg({_SHORT.format('item')}, ' o ' ORDER BY idx) AS text FROM t JOIN items ON head = o WHERE p = {_q('owl:propertyChainAxiom')} GROUP BY s", ["owl:propertyChainAxiom", *LISTS])
on_triples("v11_statement_groups", lambda t: statements.statements(t, closure.materialize(classify.entities(t))).groupBy("s", X.clean_name(X.local_name(F.col("p"))).alias("label")).agg(F.array_join(F.array_sort(F.collect_set("o")), "|").alias("vals")), ENTITIES + _CONSUMED + f" SELECT s, {_CLEAN.format('p')} AS label, array_to_string(list_sort(list(DISTINCT o)), '|') AS vals FROM stmts GROUP BY 1, 2")
def _classes(t: DataFrame) -> DataFrame:
    return patterns.match(t, p="rdf:type", o="owl:Class").where("s_kind = 'iri'").select(F.col("s").alias("id"))


_TREE_SQL = f""", n AS (SELECT DISTINCT s AS id FROM t WHERE p = {_q('rdf:type')} AND o = {_q('owl:Class')} AND s_kind = 'iri'),
e AS (SELECT DISTINCT s AS child, o AS parent FROM t WHERE p = {_q('rdfs:subClassOf')} AND s <> o AND s IN (SELECT id FROM n) AND o IN (SELECT id FROM n))"""
on_triples("v12_hierarchy", lambda t: views.hierarchy(t, "rdfs:subClassOf", _classes(t)), _TREE_SQL + f""",
tree AS (SELECT id AS node, [id] AS way FROM n WHERE id NOT IN (SELECT child FROM e) UNION ALL SELECT child, list_append(way, child) FROM tree JOIN e ON parent = node WHERE NOT list_contains(way, child))
SELECT node, array_to_string(list_transform(way, lambda x: {_SHORT.format('x')}), '/') AS path, CAST(len(way) - 1 AS BIGINT) AS depth FROM tree""", ["rdf:type", "rdfs:subClassOf"])
on_triples("v12_forest", lambda t: views.forest(t, "rdfs:subClassOf", _classes(t)), _TREE_SQL + _labels_sql("en") + f""",
steps AS (SELECT id AS node, 0 AS depth FROM n WHERE id NOT IN (SELECT child FROM e) UNION SELECT child, depth + 1 FROM steps JOIN e ON parent = node WHERE depth < 64),
least_ AS MATERIALIZED (SELECT node, min(depth) AS depth FROM steps GROUP BY node),
placed AS MATERIALIZED (SELECT c.node, c.depth, coalesce(best.label, {_CLEAN.format('c.node')}) AS label, (SELECT min(e.parent) FROM e JOIN least_ u ON u.node = e.parent WHERE e.child = c.node AND u.depth = c.depth - 1) AS parent FROM least_ c LEFT JOIN best ON best.id = c.node),
tree AS (SELECT node, [{{'label': label, 'node': node}}] AS way FROM placed WHERE parent IS NULL UNION ALL SELECT c.node, list_append(way, {{'label': c.label, 'node': c.node}}) FROM tree JOIN placed c ON c.parent = tree.node),
size AS (SELECT node, count(*) AS below FROM (SELECT unnest(list_transform(way, lambda x: x.node)) AS node FROM tree) GROUP BY node),
num AS (SELECT placed.*, row_number() OVER (ORDER BY way) AS enter, row_number() OVER (ORDER BY way) + below - 1 AS leave FROM tree JOIN placed USING (node) JOIN size USING (node))
SELECT node, parent, label, CAST(depth AS BIGINT) AS depth, enter, leave, true AS in_tree FROM num
UNION ALL SELECT node, e.parent, label, CAST(depth AS BIGINT), enter, leave, false FROM num JOIN e ON e.child = node WHERE e.parent IS DISTINCT FROM num.parent AND e.parent IN (SELECT node FROM num)""", ["rdf:type", "rdfs:subClassOf", "skos:prefLabel", "rdfs:label"], shared=True)

on_triples("v8_language_values", lambda t: views.in_language(populate.literals(t), "en").groupBy("attr", "lang").agg(F.count("*").alias("n")), f" SELECT CASE p WHEN {_q('rdfs:label')} THEN 'has_label' ELSE 'has_comment' END AS attr, o_lang AS lang, count(DISTINCT (s, o)) AS n FROM t WHERE o_kind = 'literal' AND p IN {_in('rdfs:label', 'rdfs:comment')} AND (o_lang = '' OR starts_with(lower(o_lang), 'en')) GROUP BY 1, 2", ["rdfs:label", "rdfs:comment"])
on_triples("v19_literal_pick", lambda t: views.literal_pick(t.select(F.col("s").alias("id"), F.lit("has_preferred_label").alias("attr"), F.col("o").alias("v"), F.col("o_lang").alias("lang")), "de"), " SELECT s AS id, 'has_preferred_label' AS attr, arg_min(o, (lower(o_lang) <> 'de', o_lang, o)) AS v FROM t GROUP BY s", ["skos:prefLabel"])
on_triples("v21_link_anchors", lambda t: views.link_anchors(classify.created_from_types(t).select(F.col("id").alias("uri"), "cls", X.anchor(F.col("id"), F.col("cls")).alias("anchor_id"))), _rules_sql() + f", m AS (SELECT DISTINCT s AS id, cls FROM t JOIN tr ON t.o = tr.o WHERE p = {_q('rdf:type')}), e AS (SELECT id, cls FROM m UNION ALL SELECT DISTINCT s, 'Individual' FROM t WHERE p = {_q('rdf:type')} AND s_kind = 'iri' AND s NOT IN (SELECT id FROM m)) SELECT id AS uri, 'id_' || md5(id) || '_' || min(cls) AS anchor_id FROM e GROUP BY id", ["rdf:type"])
on_triples("k3_ntriples", serialize.nt_lines, r""" SELECT CASE s_kind WHEN 'bnode' THEN s ELSE '<' || s || '>' END || ' <' || p || '> ' || CASE o_kind WHEN 'bnode' THEN o WHEN 'iri' THEN '<' || o || '>' ELSE '"' || replace(replace(replace(replace(replace(o, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '"' || CASE WHEN o_lang <> '' THEN '@' || o_lang ELSE '' END END || ' .' AS value FROM t""", ["rdfs:label", "rdfs:comment", "owl:hasValue", "owl:onProperty", "skos:prefLabel"])


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet")


_LIKELY = " OR ".join([f"ends_with(rtrim(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), '{x}')" for x in views.EXTENSIONS] + [f"contains(lower(trim(url)), '{x}')" for x in views.REGISTRIES + views.KEYWORDS] + [f"(contains(lower(trim(url)), 'w3.org') AND contains(lower(trim(url)), '{x}'))" for x in views.W3C_CORE])
register("v13_likely_ontology", lambda s, d: _pages(s, d).select("page_id", "url", views.likely_ontology(F.col("url")).alias("flag")), f"SELECT page_id, url, starts_with(url, 'http') AND ({_LIKELY}) AS flag FROM pages")

# ------------------------------------------------------------------ validation and sources

register("val1_size", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", (F.octet_length("text") <= 4096).alias("fits")), "SELECT doc_id, strlen(text) <= 4096 AS fits FROM documents")
register("val2_extension", lambda s, d: _pages(s, d).select("page_id", validate.extension_verdict(F.col("url")).alias("verdict")), f"SELECT page_id, CASE WHEN coalesce(url, '') = '' THEN 'missing' WHEN lower(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '[^/](\\.[^./]*)$', 1)) IN {tuple(validate.SUFFIXES)} THEN 'ok' ELSE 'extension' END AS verdict FROM pages")
_ADDRESS = "CAST(c_custkey % 256 AS STRING) || '.' || CAST(c_nationkey * 11 % 256 AS STRING) || '.0.' || CAST(c_custkey % 7 AS STRING)"
_V4 = "(a IN (0, 10, 127) OR a >= 224 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) OR (a = 192 AND b = 0 AND (c = 2 OR (c = 0 AND d NOT IN (9, 10)))))"
_OCTETS = "c_custkey % 256 AS a, c_nationkey * 11 % 256 AS b, 0 AS c, c_custkey % 7 AS d"
register("val3_address", lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.expr(_ADDRESS).alias("ip")).withColumn("blocked", validate.special_address(F.col("ip"))), f"WITH x AS (SELECT c_custkey, {_ADDRESS} AS ip, {_OCTETS} FROM customer) SELECT c_custkey, ip, {_V4} AS blocked FROM x")
_ADDRESS_V6 = f"CASE c_custkey % 4 WHEN 0 THEN '2001:' || lower(hex(c_custkey % 4000)) || '::' || lower(hex(c_nationkey + 1)) WHEN 1 THEN lower(hex(c_custkey * 97 % 65536)) || ':1:2:3:4:5:6:' || lower(hex(CAST(c_nationkey AS BIGINT))) WHEN 2 THEN '::FFFF:' || {_ADDRESS} ELSE lower(hex(64512 + c_custkey * 37 % 1024)) || '::1' END"
register("val3_address_v6", lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.expr(_ADDRESS_V6).alias("ip")).withColumn("blocked", validate.special_address(F.col("ip"))), f"""WITH x AS (SELECT c_custkey, {_ADDRESS_V6} AS ip, c_custkey % 4 AS kind, {_OCTETS}, c_nationkey + 1 AS host, c_custkey % 4000 AS g, CASE c_custkey % 4 WHEN 1 THEN c_custkey * 97 % 65536 ELSE 64512 + c_custkey * 37 % 1024 END AS f FROM customer)
SELECT c_custkey, ip, CASE kind WHEN 0 THEN g = 3512 OR (g < 512 AND g <> 3 AND g NOT BETWEEN 32 AND 63 AND NOT (g = 1 AND host IN (1, 2))) WHEN 2 THEN {_V4} ELSE f < 8192 OR f IN (8193, 8194) OR (f >= 16384 AND f NOT BETWEEN 65216 AND 65279) END AS blocked FROM x""")
register("val4_url", lambda s, d: _pages(s, d).select("page_id", validate.url_verdict(F.col("url")).alias("verdict")), r"""WITH x AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host FROM pages),
y AS (SELECT *, regexp_full_match(host, '(0|[1-9]\d{0,2})(\.(0|[1-9]\d{0,2})){3}') AS dotted, TRY_CAST(split_part(host, '.', 1) AS INT) AS a, TRY_CAST(split_part(host, '.', 2) AS INT) AS b, TRY_CAST(split_part(host, '.', 3) AS INT) AS c, TRY_CAST(split_part(host, '.', 4) AS INT) AS d FROM x)
SELECT page_id, CASE WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN host = '' THEN 'host' WHEN dotted AND greatest(a, b, c, d) < 256 AND """ + _V4 + " THEN 'address' ELSE 'ok' END AS verdict FROM y")
register("val5_text", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", validate.text_verdict(F.col("text").cast("binary")).alias("verdict")), r"SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'empty' WHEN regexp_matches(text, '^(%PDF|BZh|GIF87a|GIF89a|MZ|%!PS)') THEN 'binary' WHEN 20 * (length(substr(text, 1, 8192)) - length(regexp_replace(substr(text, 1, 8192), '[\x00-\x08\x0E-\x1F]', '', 'g'))) > length(substr(text, 1, 8192)) THEN 'control' ELSE 'ok' END AS verdict FROM documents")
register("val6_xml", lambda s, d: _pages(s, d).select("page_id", validate.xml_verdict(F.col("html")).alias("verdict")), r"""WITH x AS (SELECT page_id, html, strpos(lower(html), '<!doctype') AS pos FROM pages),
y AS (SELECT *, substr(html, pos) AS rest FROM x),
z AS (SELECT *, strpos(rest, '[') AS b, strpos(rest, '>') AS e FROM y),
v AS (SELECT page_id, CASE WHEN pos = 0 THEN NULL WHEN b > 0 THEN CASE WHEN strpos(substr(rest, b), ']') > 0 THEN substr(rest, b, strpos(substr(rest, b), ']')) ELSE substr(rest, b) END WHEN e > 0 THEN substr(rest, 1, e) ELSE rest END AS sub FROM z)
SELECT page_id, CASE WHEN sub IS NULL THEN 'ok' WHEN length(sub) > 51200 THEN 'size' WHEN regexp_matches(lower(sub), '<!entity\s*%') THEN 'parameter' WHEN contains(lower(sub), 'system') OR contains(lower(sub), 'public') THEN 'external' WHEN len(regexp_extract_all(lower(sub), '<!entity')) > 100 THEN 'entities' WHEN regexp_matches(sub, '&[\pL_][\pL\pN_.\-]{0,63};') THEN 'nested' ELSE 'ok' END AS verdict FROM v""")
register("val7_entityref", lambda s, d: _pages(s, d).select("page_id", validate.has_entity_reference(F.col("html")).alias("found")), r"SELECT page_id, regexp_matches(html, '&[\pL_][\pL\pN_.\-]{0,63};') AS found FROM pages")
on_triples("src9_import_closure", imports.import_closure, _reach("owl:imports") + " SELECT a AS model, b AS imported, depth FROM reach", ["owl:imports"])
on_triples("src10_imports_of_a_root", lambda t: imports.import_closure(t, imports.direct_imports(t).groupBy().agg(F.min("model").alias("model"))), _reach("owl:imports") + f" SELECT a AS model, b AS imported, depth FROM reach WHERE a = (SELECT min(s) FROM t WHERE p = {_q('owl:imports')})", ["owl:imports"])
_COMPONENTS_SQL = _reach("owl:imports") + """, ends AS (SELECT a AS id FROM steps UNION SELECT b FROM steps),
part AS (SELECT id AS model, coalesce(least(id, (SELECT min(x.b) FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a WHERE x.a = id)), id) AS component FROM ends)"""
on_triples("src9_import_components", imports.import_components, _COMPONENTS_SQL + " SELECT model, component, count(*) OVER (PARTITION BY component) AS size FROM part", ["owl:imports"], shared=True)
on_triples("src9_component_links", imports.component_links, _COMPONENTS_SQL + " SELECT x.component, y.component AS imported, count(*) AS n FROM steps JOIN part x ON x.model = a JOIN part y ON y.model = b WHERE x.component <> y.component GROUP BY 1, 2", ["owl:imports"], shared=True)
on_triples("src8_direct_imports", imports.direct_imports, f" SELECT s AS model, o AS imported FROM t WHERE p = {_q('owl:imports')} GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY s, o"), ["owl:imports"])
register("src12_token", lambda s, d: _pages(s, d).select("page_id", X.url_token(F.col("url"), "owl", False, True).alias("token")), "SELECT page_id, 'url_' || substr(sha256(url || '|owl|False|True'), 1, 32) AS token FROM pages")
def _spooled(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("spool"), F.col("event_id").alias("name"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("mtime"), (F.col("user_id") + 1).alias("size"))


def _spool_sql(by: str) -> str:
    return f"WITH f AS (SELECT event_type AS spool, event_id AS name, user_id + 1 AS size, CAST(floor(epoch(ts)) AS BIGINT) AS mtime FROM events), r AS (SELECT spool, name, sum(size) OVER ({by}ORDER BY mtime DESC, name DESC ROWS UNBOUNDED PRECEDING) AS total FROM f WHERE mtime >= 1735689600 - 1000000000) SELECT spool, name FROM r WHERE total <= "


register("src14_spool_eviction", lambda s, d: spool.kept(_spooled(s, d), now=1735689600, ttl=10**9, budget=20_000, by="spool").select("spool", "name"), _spool_sql("PARTITION BY spool ") + "20000")
register("src14_one_spool", lambda s, d: spool.kept(_spooled(s, d), now=1735689600, ttl=10**9, budget=100_000).select("spool", "name"), _spool_sql("") + "100000")
register("k2_slug", lambda s, d: _pages(s, d).select("page_id", X.slug(F.col("url")).alias("slug")), "SELECT page_id, replace(replace(regexp_replace(url, '^https?://', ''), '/', '_'), '#', '_') AS slug FROM pages")
register("k5_nav_qs", lambda s, d: _pages(s, d).select("page_id", X.query_string(read_as=F.lit("owl"), url=F.col("url"), lang=F.lit(None).cast("string")).alias("qs")), "SELECT page_id, 'read_as=owl&url=' || replace(url_encode(url), '%20', '+') AS qs FROM pages")

# ------------------------------------------------------------------ all values

_LITERAL_ATTRS = _values("la", "p, attr", [(r.name, a) for r in R.predicate_rules() for a, kind in r.setters.items() if kind == "Literal"])
_SETTERS = _values("su", "is_type, name, attr, constant", R.setter_rows())
_SYMMETRIC = _values("sy", "p, attr", [(r.name, r.handler.split(":")[1]) for r in R.predicate_rules() if (r.handler or "").startswith("symmetric:")])
_LISTED = _values("li", "p, attr", [(iri(p), a) for p, a in values.LISTED.items()])
_GROUPS = _values("gr", "type, p, attr", [(iri("owl:AllDisjointClasses"), iri("owl:members"), "is_disjoint_with"), (iri("owl:AllDifferent"), iri("owl:distinctMembers"), "is_different_from"), (iri("owl:AllDisjointProperties"), iri("owl:members"), "is_disjoint_with")])
_KEPT_TYPE = f"p = {_q('rdf:type')} AND (NOT ({_STRUCTURAL}) OR o IN {_in('owl:Thing', 'owl:Nothing', 'rdfs:Literal')})"
def _of_scope(sql: str) -> str:
    """``sql`` over the triples that fill something in."""
    sql = re.sub(r"\b(FROM|JOIN) t (?=(?:LEFT|JOIN|WHERE|USING|ON|GROUP)\b)", r"\1 sc t ", sql)
    return re.sub(r"\b(FROM|JOIN) t (?=[a-z] )", r"\1 sc ", sql)


_VALUES_SQL = (
    _GONE_SQL + _TRUTH_VALUES_SQL + _CONSUMED + """,
sc AS MATERIALIZED (SELECT * FROM t WHERE p = 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' OR s IN (SELECT s FROM structured) OR (s, p, o, o_lang) IN (SELECT (s, p, o, o_lang) FROM used))""" + _of_scope(_CARD_SQL + f""", {_LITERAL_ATTRS}, {_SETTERS}, {_SYMMETRIC}, {_LISTED}, {_GROUPS},
sym AS (SELECT s AS a, o AS b, attr FROM t JOIN sy USING (p) WHERE o_kind <> 'literal' AND s <> o),
du AS (SELECT DISTINCT s AS owner, '_:u' || substr(sha256(s || chr(10) || o), 1, 32) AS node, idx, item FROM t JOIN items ON head = o WHERE p = {_q('owl:disjointUnionOf')}),
grp AS (SELECT s AS owner, attr, idx, item FROM t JOIN items ON head = o JOIN gr ON gr.p = t.p WHERE (s, type) IN (SELECT (s, o) FROM t WHERE p = {_q('rdf:type')}) UNION ALL SELECT node, 'is_disjoint_with', idx, item FROM du),
two AS (SELECT x.attr, x.item AS a, y.item AS b FROM grp x JOIN grp y ON x.owner = y.owner AND x.attr = y.attr AND x.idx < y.idx AND x.item <> y.item),
fa AS (SELECT f.s AS id, i.idx, {_FACETS.replace('CASE p', 'CASE v.p')} AS comparator, v.o AS v FROM t f JOIN items i ON i.head = f.o JOIN t v ON v.s = i.item AND v.p IN {_in(*FACETS)} WHERE f.p = {_q('owl:withRestrictions')}),
atoms AS (SELECT s AS rule, p, idx, item FROM t JOIN items ON head = o WHERE p IN {_in('swrl:body', 'swrl:head')}),
everything AS (
  SELECT s AS id, attr, 0 AS ord, o AS v, o_lang AS lang FROM t JOIN la USING (p) WHERE o_kind = 'literal'
  UNION ALL SELECT s, 'has_type', 0, o, '' FROM t WHERE {_KEPT_TYPE}
  UNION ALL SELECT o, 'individuals_with_this_type', 0, s, '' FROM t WHERE {_KEPT_TYPE}
  UNION ALL SELECT s, attr, 0, coalesce(constant, o), '' FROM t JOIN su ON NOT is_type AND name = p
  UNION ALL SELECT s, attr, 0, constant, '' FROM t JOIN su ON is_type AND name = o WHERE p = {_q('rdf:type')}
  UNION ALL SELECT a, attr, 0, b, '' FROM sym UNION ALL SELECT b, attr, 0, a, '' FROM sym
  UNION ALL SELECT s, 'has_member', CAST(regexp_extract(p, '_(\\d+)$', 1) AS BIGINT), o, '' FROM t WHERE starts_with(p, {_q('rdf:_')}) AND s IN (SELECT s FROM t WHERE p = {_q('rdf:type')} AND o IN {_in('rdf:Bag', 'rdf:Alt', 'rdf:Seq')})
  UNION ALL SELECT s, attr, idx, item, '' FROM t JOIN li USING (p) JOIN items ON head = o
  UNION ALL SELECT restriction, 'applies_on_property', 0, property, '' FROM onp UNION ALL SELECT restriction, 'is_inverse', 0, 'True', '' FROM onp WHERE is_inverse
  UNION ALL SELECT id, 'has_cardinality_type', 0, kind, '' FROM card UNION ALL SELECT id, 'has_cardinality', 0, CAST(n AS VARCHAR), '' FROM card
  UNION ALL SELECT id, 'applies_on_concept', 0, filler, '' FROM card UNION ALL SELECT s, 'applies_on_resource', 0, o, '' FROM t WHERE p = {_q('owl:hasValue')}
  UNION ALL SELECT id, attr, ord, v, '' FROM tv
  UNION ALL SELECT id, 'has_facet', idx, comparator, '' FROM fa UNION ALL SELECT id, 'has_restriction_value', idx, v, '' FROM fa
  UNION ALL SELECT fa.id, 'applies_on_concept', 0, (SELECT min(o) FROM t WHERE s = fa.id AND p = {_q('owl:onDatatype')}), '' FROM fa
  UNION ALL SELECT owner, 'is_equivalent_to', 0, node, '' FROM du UNION ALL SELECT node, 'has_logical_operator', 0, 'or', '' FROM du UNION ALL SELECT node, 'applies_on_concept', idx, item, '' FROM du
  UNION ALL SELECT a, attr, 0, b, '' FROM two UNION ALL SELECT b, attr, 0, a, '' FROM two
  UNION ALL SELECT rule, CASE p WHEN {_q('swrl:body')} THEN 'has_antecedent' ELSE 'has_consequent' END, idx, item, '' FROM atoms
  UNION ALL SELECT item, 'has_predicate', 0, (SELECT min(o) FROM t WHERE s = item AND p IN {_in('swrl:classPredicate', 'swrl:propertyPredicate', 'swrl:builtin', 'swrl:dataRange')}), '' FROM atoms
  UNION ALL SELECT s, 'has_arguments', CASE p WHEN {_q('swrl:argument1')} THEN 1 ELSE 2 END, o, '' FROM t WHERE p IN {_in('swrl:argument1', 'swrl:argument2')})""")
)
_ALL_VALUES = """SELECT DISTINCT id, attr, CAST(ord AS BIGINT) AS ord, v, lang FROM everything WHERE v IS NOT NULL AND id NOT IN (SELECT id FROM gone) AND v NOT IN (SELECT id FROM gone)"""
on_triples("e1_values", _with_entities(values.stated), _VALUES_SQL + _ALL_VALUES)


# ------------------------------------------------------------------ cards


def _relations(t: DataFrame, items: DataFrame, found: DataFrame) -> DataFrame:
    nested = statements.nested_values(statements.nested_parts(t, found, closure.materialize(_lists_of_nodes(t))))
    nodes = closure.materialize(cards.known_nodes(t, found, views.restriction_texts(t, items), nested))
    return cards.relations(closure.materialize(values.stated(t, items, found)), nodes)


_NAME_SQL = _CLEAN.format("attr")
_FIRST = "CASE name " + " ".join(f"WHEN '{x}' THEN {k}" for k, x in enumerate(cards.FIRST_NAMES)) + f" ELSE {len(cards.FIRST_NAMES)} END"
_strings = lambda names: "(" + ", ".join(f"'{x}'" for x in names) + ")"
on_triples("v6_relations", _with_entities(_relations), _VALUES_SQL + f""", ev AS MATERIALIZED ({_ALL_VALUES}),
txt AS MATERIALIZED (WITH RECURSIVE {_TEXTS_SQL.lstrip(", ")}),
deep AS MATERIALIZED (WITH RECURSIVE {_NESTED_SQL.lstrip().lstrip(",")}, w AS (SELECT id, o, kind, 1 AS depth FROM parts WHERE pos = 0 UNION ALL SELECT w.id, x.o, x.kind, depth + 1 FROM w JOIN parts x ON x.id = w.o WHERE w.kind = 'statement' AND x.pos = 0 AND depth < 20) SELECT id, min(o) AS text FROM w WHERE kind <> 'statement' GROUP BY id)""" + _labels_sql("en") + f""",
first AS (SELECT id, min(cls) AS kind FROM ent GROUP BY id),
old AS (SELECT DISTINCT s AS id FROM t WHERE p = {_q('owl:deprecated')} OR (p = {_q('rdf:type')} AND o = {_q('owl:DeprecatedClass')})),
shown AS (SELECT id, attr, {_NAME_SQL} AS name, ord, v, lang, attr IN {_strings(cards.literal_attributes())} AS is_literal FROM ev WHERE attr NOT IN {_strings(cards.hidden_attributes())} AND (lang = '' OR starts_with(lower(lang), 'en'))),
rows AS (SELECT x.id, name, ord, lang,
  CASE WHEN is_literal THEN v WHEN kind IN {_strings(cards.RESTRICTIONS)} THEN txt.text WHEN kind IS NOT NULL THEN coalesce(label, {_CLEAN.format('v')}) WHEN deep.text IS NOT NULL THEN deep.text WHEN NOT starts_with(v, '_:') THEN v END AS text,
  CASE WHEN NOT is_literal AND kind NOT IN {_strings(cards.RESTRICTIONS)} THEN v END AS link,
  CASE WHEN is_literal THEN 'Literal' WHEN kind IS NOT NULL THEN kind WHEN deep.text IS NOT NULL THEN 'Statement' END AS kind,
  NOT is_literal AND kind IS NOT NULL AND old.id IS NOT NULL AS is_deprecated
  FROM shown x LEFT JOIN first ON first.id = v LEFT JOIN txt ON txt.id = v LEFT JOIN best ON best.id = v LEFT JOIN deep ON deep.id = v LEFT JOIN old ON old.id = v)
SELECT DISTINCT id, CAST({_FIRST} AS BIGINT) AS rank, name, ord, text, link, lang, kind, is_deprecated FROM rows WHERE text <> ''""")
on_triples("tp10_instance_json", _with_entities(lambda t, items, found: cards.instance_json(t, found, closure.materialize(values.stated(t, items, found)))), _VALUES_SQL + f""", ev AS MATERIALIZED ({_ALL_VALUES}),
kinds AS (SELECT id, list(DISTINCT cls ORDER BY cls) AS type FROM ent WHERE cls <> 'Literal' GROUP BY id),
entries AS (SELECT id, false AS is_triple, attr AS a, ord, v AS b, lang FROM ev UNION SELECT s, true, p, 0, o, o_lang FROM t),
placed AS (SELECT *, (row_number() OVER (PARTITION BY id ORDER BY is_triple, a, ord, b, lang) - 1) // {cards.PIECE} AS piece FROM entries WHERE id IN (SELECT id FROM kinds)),
listed AS (SELECT id, piece, is_triple, a, list(b ORDER BY ord, b, lang) AS vs FROM placed GROUP BY ALL),
props AS (SELECT id, piece, map_from_entries(list((a, vs) ORDER BY a)) AS m FROM listed WHERE NOT is_triple GROUP BY ALL),
own AS (SELECT id, piece, list({{'subject': id, 'predicate': a, 'object': b}} ORDER BY a, b, lang) AS l FROM placed WHERE is_triple GROUP BY ALL),
keys AS (SELECT DISTINCT id, piece FROM placed)
SELECT id, coalesce(piece, 0) AS piece, CAST(to_json({{'uri': id, 'type': type, 'properties': coalesce(m, MAP {{}}), 'rdf_triples': coalesce(l, [])}}) AS VARCHAR) AS json FROM kinds LEFT JOIN keys USING (id) LEFT JOIN props USING (id, piece) LEFT JOIN own USING (id, piece)""")


# ------------------------------------------------------------------ thesauri

# Titles are matched by predicate here, as each fills in one attribute: narrower turned round, related both ways.
_MAPPED = {"skos:broadMatch": "has broad match", "skos:narrowMatch": "has narrow match", "skos:exactMatch": "has exact match", "skos:closeMatch": "has close match", "skos:relatedMatch": "has related match"}
_BETWEEN = _in("skos:broader", "skos:narrower", "skos:related", *_MAPPED)
_CONCEPTS = f""",
con AS (
  SELECT s AS id FROM t WHERE p = {_q('rdf:type')} AND o = {_q('skos:Concept')}
  UNION SELECT s FROM t WHERE p IN {_BETWEEN} UNION SELECT o FROM t WHERE p IN {_BETWEEN} UNION SELECT o FROM t WHERE p IN {_in('skos:hasTopConcept', 'rdf:type')}),
col AS (SELECT s AS id FROM t WHERE p = {_q('skos:member')} OR (p = {_q('rdf:type')} AND o IN {_in('skos:Collection', 'skos:OrderedCollection')})),
card AS (SELECT id, 'Concept' AS section FROM con UNION SELECT id, 'Collection' FROM col),
labelled AS MATERIALIZED (SELECT id, coalesce(label, {_CLEAN.format('id')}) AS label FROM (SELECT s AS id FROM t UNION SELECT o FROM t WHERE o_kind = 'iri') LEFT JOIN best USING (id))"""


def on_thesaurus(name: str, run: Callable[[Ontology], DataFrame], sql: str) -> None:
    register(name, lambda spark, d: run(Ontology(lift(spark, d, specification=THESAURUS), "skos")), f"WITH t AS MATERIALIZED (SELECT DISTINCT * FROM ({lift_sql(specification=THESAURUS)})){_labels_sql('en')}{_CONCEPTS}{sql}")


on_thesaurus("v18_concept_cards", lambda own: own.concept_cards("en"), f""",
def AS (SELECT s AS id, arg_min(o, (lower(o_lang) <> 'en', o_lang, o)) AS definition FROM t WHERE p = {_q('skos:definition')} GROUP BY s)
SELECT section, id AS uri, 'id_' || md5(id) AS anchor_id, label, definition FROM card JOIN labelled USING (id) LEFT JOIN def USING (id)""")
on_thesaurus("v20_semantic_sections", lambda own: own.semantic_sections("en"), f""",
links AS (
  SELECT s AS uri, 'has members' AS title, o AS target FROM t WHERE p = {_q('skos:member')}
  UNION SELECT s, 'has super-concepts', o FROM t WHERE p = {_q('skos:broader')} UNION SELECT o, 'has super-concepts', s FROM t WHERE p = {_q('skos:narrower')}
  UNION SELECT s, 'is related to', o FROM t WHERE p = {_q('skos:related')} UNION SELECT o, 'is related to', s FROM t WHERE p = {_q('skos:related')}
  UNION SELECT s, CASE {' '.join(f"WHEN p = {_q(p)} THEN '{t}'" for p, t in _MAPPED.items())} END, o FROM t WHERE p IN {_in(*_MAPPED)})
SELECT uri, CAST(list_position(['has members', 'is equivalent to', 'has super-concepts', 'is disjoint with', 'is related to', 'has broad match', 'has narrow match', 'has exact match', 'has close match', 'has related match'], title) - 1 AS BIGINT) AS rank,
  title, target, label, 'id_' || md5(target) AS anchor_id, false AS is_external FROM links JOIN labelled ON labelled.id = target WHERE uri IN (SELECT id FROM card)""")
on_thesaurus("v18_other_relations", lambda own: own.other_relations("en"), f""" SELECT DISTINCT s AS uri, CASE p WHEN {_q('skos:altLabel')} THEN 'Alternative Label' WHEN {_q('skos:notation')} THEN 'Notation' ELSE 'Included In' END AS name, o AS v, o_lang AS lang
FROM t WHERE p IN {_in('skos:altLabel', 'skos:notation', 'skos:inScheme')} AND s IN (SELECT id FROM card) AND (o_lang = '' OR starts_with(lower(o_lang), 'en'))""")
on_thesaurus("v7_metadata_view", lambda own: own.metadata("en"), f""",
model AS (SELECT min(id) AS id FROM (SELECT s AS id FROM t WHERE p = {_q('rdf:type')} AND o = {_q('skos:ConceptScheme')} UNION SELECT o FROM t WHERE p = {_q('skos:inScheme')})),
shown AS (
  SELECT 0 AS rank, 'uri' AS name, id AS text, id AS link FROM model UNION ALL SELECT 1, 'label', label, NULL FROM labelled SEMI JOIN model USING (id)
  UNION ALL SELECT 2, 'preferred label', o, NULL FROM t JOIN model ON s = id WHERE p = {_q('skos:prefLabel')} AND o_lang IN ('', 'en')
  UNION ALL SELECT 2, CASE p WHEN {_q('skos:hasTopConcept')} THEN 'top concept' ELSE 'see also' END, label, o FROM t JOIN model ON s = model.id JOIN labelled ON labelled.id = o WHERE p IN {_in('skos:hasTopConcept', 'rdfs:seeAlso')}
  UNION ALL SELECT 3, 'covers', o, NULL FROM t JOIN model ON s = id WHERE p = 'http://ex.org/o#covers' AND o_lang IN ('', 'en'))
SELECT DISTINCT CAST(rank AS BIGINT) AS rank, name, text, link, coalesce(({_LIKELY.replace('url', 'link')}) AND starts_with(link, 'http'), false) AS is_visualizable FROM shown""")

# Asked for are all classes that have a class above them, and as many addresses that nothing describes.
on_triples("v4_resources", lambda t: views.resources_view(views.entity_cards(t, classify.entities(t)), patterns.match(t, p="rdfs:subClassOf").select(F.explode(F.array("s", F.concat("s", F.lit("/none")))).alias("uri"))), ENTITIES + _labels_sql("en") + f""",
wanted AS (SELECT DISTINCT unnest([s, s || '/none']) AS uri FROM t WHERE p = {_q('rdfs:subClassOf')}),
old AS (SELECT DISTINCT s AS id FROM t WHERE p = {_q('owl:deprecated')} OR (p = {_q('rdf:type')} AND o = {_q('owl:DeprecatedClass')}))
SELECT uri, 'id_' || md5(id) || '_' || cls AS anchor_id, cls, CASE WHEN id IS NOT NULL THEN coalesce(label, {_CLEAN.format('id')}) END AS label, CASE WHEN id IS NOT NULL THEN id IN (SELECT id FROM old) END AS is_deprecated,
  CASE WHEN id IS NULL THEN 'Resource ' || uri || ' not found' END AS error FROM wanted LEFT JOIN (SELECT * FROM ent LEFT JOIN best USING (id) WHERE cls <> 'Literal') ON id = uri""")

# The same over all entities, not what types alone give.
on_triples("g5_individual_types", lambda t: axioms.default_types(t, classify.entities(t).where("cls = 'Individual'").select("id")), ENTITIES + f" SELECT DISTINCT id, {_q('owl:Thing')} AS type FROM ent WHERE cls = 'Individual' AND id NOT IN (SELECT s FROM t WHERE p = {_q('rdf:type')} AND NOT ({_STRUCTURAL}))")
on_triples("v21_entity_anchors", lambda t: views.link_anchors(views.entity_cards(t, classify.entities(t))), ENTITIES + " SELECT id AS uri, 'id_' || md5(id) || '_' || min(cls) AS anchor_id FROM ent WHERE cls <> 'Literal' GROUP BY id")
