"""Direct mapping of relational tables to triples, as one specification for Spark and for plain SQL.

A line of the specification says which rows of a table give which triple. Tables of few lines are read once for each, so
that its triples lie in files of their own, which filters by predicate skip; of others a scan
explodes the triples of a row for several lines. SQL gets a ``UNION ALL`` of the same lines. A caller that needs some
predicates gets only their lines, so neither the others nor their tables are read.

``part`` gives an ontology that grows with it: classes and properties in trees, restrictions, lists and
axioms of all kinds. The other tables give individuals, relations, labels, containers and ordered lists.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vocab import iri

EX = "http://ex.org/"
#: Triples made in one projection: more would pass the size of a compiled method.
LINES = 8
#: Lines of a table up to which each has a scan of its own.
FEW_LINES = 4


class Line(NamedTuple):
    table: str
    where: str
    s: str
    p: str
    o: str
    kind: str
    lang: str = "''"


def text(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def named(what: str, expr: str) -> str:
    return f"'{EX}{what}/' || {text(expr)}"


def const(curie: str) -> str:
    return f"'{iri(curie)}'"


def term(name: str) -> str:
    return f"'{EX}o#{name}'"


def half(expr: str, by: int) -> str:
    return f"CAST(floor({expr} / {by}) AS BIGINT)"


def _class(expr: str = "p_partkey") -> str:
    return named("class", expr)


def _prop(expr: str = "p_partkey") -> str:
    return named("prop", expr)


def _node(what: str, expr: str = "p_partkey") -> str:
    return f"'_:{what}' || {text(expr)}"


def _list(table: str, where: str, head: str, items: list[tuple[str, str]]) -> list[Line]:
    """A linked list whose nodes are head_1, head_2, ..."""
    lines = []
    for k, (item, kind) in enumerate(items, 1):
        lines.append(Line(table, where, f"{head} || '_{k}'", const("rdf:first"), item, kind))
        last = k == len(items)
        lines.append(Line(table, where, f"{head} || '_{k}'", const("rdf:rest"), const("rdf:nil") if last else f"{head} || '_{k + 1}'", "iri" if last else "bnode"))
    return lines


def _specification() -> list[Line]:
    k = "p_partkey"
    out: list[Line] = []

    def add(table, where, s, p, o, kind="iri", lang="''"):
        out.append(Line(table, where, s, p, o, kind, lang))

    type_, label = const("rdf:type"), const("rdfs:label")

    # Classes: a binary tree, some untyped, some also individuals.
    add("part", f"{k} % 11 <> 5", _class(), type_, const("owl:Class"))
    add("part", f"{k} > 1", _class(), const("rdfs:subClassOf"), _class(half(k, 2)))
    add("part", f"{k} % 50 = 0", _class(), type_, const("owl:NamedIndividual"))
    add("part", f"{k} % 40 = 7", _class(), type_, const("owl:DeprecatedClass"))
    add("part", f"{k} % 40 = 8", _class(), const("owl:deprecated"), "'false'", "literal")
    add("part", f"{k} % 60 = 9", _class(), type_, const("rdfs:Datatype"))
    add("part", f"{k} % 20 = 3", _class(), const("owl:equivalentClass"), _class(f"{k} + 1"))
    add("part", f"{k} % 20 = 4", _class(), const("owl:disjointWith"), _class(f"{k} + 2"))
    add("part", f"{k} % 5 <> 4", _class(), label, "p_name", "literal", "'en'")
    add("part", f"{k} % 3 = 0", _class(), label, "p_brand", "literal", "'fr'")
    add("part", f"{k} % 5 = 0", _class(), const("skos:prefLabel"), "p_type", "literal")
    add("part", f"{k} % 7 = 0", _class(), const("skos:prefLabel"), "p_brand", "literal", "'de'")
    add("part", f"{k} % 6 = 1", _class(), const("rdfs:comment"), "p_type", "literal", "'en'")
    add("part", f"{k} % 60 = 19", _class(), const("rdfs:domain"), _class(f"{k} + 1"))
    # Properties: a ternary tree of typed, generic and untyped ones.
    for rest, of in ((0, "owl:ObjectProperty"), (1, "owl:DatatypeProperty"), (2, "owl:AnnotationProperty"), (3, "rdf:Property"), (4, "rdf:Property")):
        add("part", f"{k} % 6 = {rest}", _prop(), type_, const(of))
    add("part", f"{k} % 48 = 1", _prop(), type_, const("owl:ObjectProperty"))
    add("part", f"{k} > 2", _prop(), const("rdfs:subPropertyOf"), _prop(half(k, 3)))
    add("part", f"{k} % 4 = 0", _prop(), const("rdfs:domain"), _class())
    add("part", f"{k} % 8 = 1", _prop(), const("rdfs:range"), const("xsd:decimal"))
    add("part", f"{k} % 8 = 4", _prop(), const("rdfs:range"), _class(f"{k} + 1"))
    add("part", f"{k} % 12 = 0", _prop(), const("owl:inverseOf"), _prop(f"{k} + 6"))
    add("part", f"{k} % 36 = 0", _prop(), const("owl:inverseOf"), _prop(f"{k} + 12"))
    add("part", f"{k} % 18 = 0", _prop(), type_, const("owl:FunctionalProperty"))
    add("part", f"{k} % 24 = 6", _prop(), type_, const("owl:TransitiveProperty"))
    add("part", f"{k} % 30 = 2", _prop(), const("owl:equivalentProperty"), _prop(f"{k} + 30"))
    add("part", f"{k} % 30 = 5", _prop(), const("owl:propertyDisjointWith"), _prop(f"{k} + 1"))
    add("part", f"{k} % 10 = 3", _class(), _prop(), _class(f"{k} + 1"))
    add("part", f"{k} % 10 = 4", _class(), _prop(), "p_type", "literal")
    # Restrictions, some without a property, some with two kinds at once.
    r = _node("r")
    add("part", f"{k} % 2 = 0", _class(), const("rdfs:subClassOf"), r, "bnode")
    add("part", f"{k} % 2 = 0", r, type_, const("owl:Restriction"))
    add("part", f"{k} % 2 = 0 AND {k} % 26 <> 0 AND {k} % 10 <> 4", r, const("owl:onProperty"), _prop())
    add("part", f"{k} % 2 = 0 AND {k} % 26 <> 0 AND {k} % 10 = 4", r, const("owl:onProperty"), _node("i"), "bnode")
    add("part", f"{k} % 2 = 0 AND {k} % 26 <> 0 AND {k} % 10 = 4", _node("i"), const("owl:inverseOf"), _prop())
    add("part", f"{k} % 16 IN (0, 12)", r, const("owl:someValuesFrom"), _class(f"{k} + 1"))
    add("part", f"{k} % 16 = 2", r, const("owl:allValuesFrom"), _class(f"{k} + 1"))
    add("part", f"{k} % 16 = 4", r, const("owl:minCardinality"), text("p_size"), "literal")
    add("part", f"{k} % 16 = 6", r, const("owl:qualifiedCardinality"), text("p_size"), "literal")
    add("part", f"{k} % 16 = 6", r, const("owl:onClass"), _class(f"{k} + 2"))
    add("part", f"{k} % 16 = 8", r, const("owl:hasValue"), "p_brand", "literal")
    add("part", f"{k} % 16 = 10", r, const("owl:maxQualifiedCardinality"), text("p_size"), "literal")
    add("part", f"{k} % 16 = 10", r, const("owl:onDataRange"), const("xsd:decimal"))
    add("part", f"{k} % 16 = 12", r, const("owl:cardinality"), "'1'", "literal")
    add("part", f"{k} % 16 = 14", r, const("owl:hasSelf"), "'true'", "literal")
    add("part", f"{k} % 52 = 25", _node("q"), const("owl:someValuesFrom"), _class(f"{k} + 1"))
    add("part", f"{k} % 52 = 25", _node("q"), const("owl:onProperty"), "'none'", "literal")
    # Boolean classes with 0 to 3 members, complements, enumerations.
    for of, rest in (("owl:intersectionOf", 0), ("owl:unionOf", 1)):
        for n in range(4):
            where = f"{k} % 9 = 0 AND {k} % 2 = {rest} AND {k} % 4 = {n}"
            if n % 2 != rest:
                continue
            add("part", where, _class(), const("owl:equivalentClass"), _node("t"), "bnode")
            add("part", where, _node("t"), type_, const("owl:Class"))
            add("part", where, _node("t"), const(of), f"{_node('t')} || '_1'" if n else const("rdf:nil"), "bnode" if n else "iri")
            out.extend(_list("part", where, _node("t"), [(_class(f"{k} + {j}"), "iri") for j in range(1, n + 1)]))
    # Named classes that are truth functions themselves: of 0 to 3 members, the first one a restriction without a property
    # or, further on, a sound one; one complement; nested ones that a restriction takes with it, or doesn't.
    for rest, shift, of in ((0, 0, "owl:unionOf"), (13, 1, "owl:intersectionOf")):
        for n in range(4):
            where = f"{k} % 26 = {rest} AND floor({k} / 26) % 4 = {n}"
            add("part", where, _class(), const(of), f"{_node('y')} || '_1'" if n else const("rdf:nil"), "bnode" if n else "iri")
            out.extend(_list("part", where, _node("y"), [(_node("r", f"{k} + {shift}"), "bnode"), (_class(f"{k} + 1"), "iri"), (_class(f"{k} + 2"), "iri")][:n]))
    add("part", f"{k} % 26 = 14", _class(), const("owl:complementOf"), _class(f"{k} + 1"))
    add("part", f"{k} % 26 = 0", _class(), const("rdfs:subClassOf"), _node("z"), "bnode")
    add("part", f"{k} % 26 = 0", _node("z"), const("owl:intersectionOf"), f"{_node('z')} || '_1'", "bnode")
    out.extend(_list("part", f"{k} % 52 = 0", _node("z"), [(_node("zz"), "bnode")]))
    out.extend(_list("part", f"{k} % 52 = 26", _node("z"), [(_node("zz"), "bnode"), (_class(f"{k} + 1"), "iri")]))
    add("part", f"{k} % 26 = 0", _node("zz"), const("owl:complementOf"), r, "bnode")
    add("part", f"{k} % 9 = 3", _class(), const("owl:equivalentClass"), _node("c"), "bnode")
    add("part", f"{k} % 9 = 3", _node("c"), const("owl:complementOf"), _class(f"{k} + 1"))
    add("part", f"{k} % 9 = 6", _class(), const("owl:equivalentClass"), _node("e"), "bnode")
    add("part", f"{k} % 9 = 6", _node("e"), const("owl:oneOf"), f"{_node('e')} || '_1'", "bnode")
    out.extend(_list("part", f"{k} % 9 = 6", _node("e"), [(named("nation", f"{k} % 25"), "iri"), (named("nation", f"({k} + 1) % 25"), "iri"), (named("nation", f"({k} + 2) % 25"), "iri")]))
    # Chains (some not a list), keys, disjoint unions, facets.
    add("part", f"{k} % 15 = 0", _prop(), const("owl:propertyChainAxiom"), f"{_node('p')} || '_1'", "bnode")
    out.extend(_list("part", f"{k} % 15 = 0", _node("p"), [(_prop(f"{k} + 1"), "iri"), (_prop(f"{k} + 2"), "iri")]))
    add("part", f"{k} % 45 = 30", _prop(), const("owl:propertyChainAxiom"), _prop(f"{k} + 1"))
    add("part", f"{k} % 15 = 2", _class(), const("owl:hasKey"), f"{_node('h')} || '_1'", "bnode")
    out.extend(_list("part", f"{k} % 15 = 2", _node("h"), [(_prop(), "iri"), (_prop(f"{k} + 3"), "iri")]))
    add("part", f"{k} % 15 = 3", _class(), const("owl:disjointUnionOf"), f"{_node('u')} || '_1'", "bnode")
    out.extend(_list("part", f"{k} % 15 = 3", _node("u"), [(_class(f"{k} * 2"), "iri"), (_class(f"{k} * 2 + 1"), "iri")]))
    d = _node("f")
    add("part", f"{k} % 14 = 7", _class(), const("owl:equivalentClass"), d, "bnode")
    add("part", f"{k} % 14 = 7", d, const("owl:onDatatype"), const("xsd:double"))
    add("part", f"{k} % 14 = 7", d, const("owl:withRestrictions"), f"{d} || '_1'", "bnode")
    out.extend(_list("part", f"{k} % 14 = 7", d, [(f"{d} || 'a'", "bnode"), (f"{d} || 'b'", "bnode")]))
    add("part", f"{k} % 14 = 7", f"{d} || 'a'", const("xsd:minInclusive"), "'0'", "literal")
    add("part", f"{k} % 14 = 7", f"{d} || 'b'", const("xsd:maxExclusive"), text("p_size"), "literal")
    # Group axioms and rules.
    for name, of, p, what in (("ad", "owl:AllDisjointClasses", "owl:members", _class), ("ap", "owl:AllDisjointProperties", "owl:members", _prop)):
        where = f"{k} % 25 = {1 if name == 'ad' else 2}"
        add("part", where, _node(name), type_, const(of))
        add("part", where, _node(name), const(p), f"{_node(name)} || '_1'", "bnode")
        out.extend(_list("part", where, _node(name), [(what(f"{k} + {j}"), "iri") for j in range(3)]))
    where = f"{k} % 25 = 3"
    add("part", where, _node("aq"), type_, const("owl:AllDifferent"))
    add("part", where, _node("aq"), const("owl:distinctMembers"), f"{_node('aq')} || '_1'", "bnode")
    out.extend(_list("part", where, _node("aq"), [(named("nation", f"{k} % 25"), "iri"), (named("nation", f"({k} + 4) % 25"), "iri"), (named("nation", f"({k} + 9) % 25"), "iri")]))
    where = f"{k} % 25 = 4"
    add("part", where, _node("w"), type_, const("swrl:Imp"))
    for side, atom in (("body", "a"), ("head", "b")):
        add("part", where, _node("w"), const(f"swrl:{side}"), f"{_node('w')} || '{atom}_1'", "bnode")
        out.extend(_list("part", where, f"{_node('w')} || '{atom}'", [(f"{_node('w')} || '{atom}'", "bnode")]))
    add("part", where, f"{_node('w')} || 'a'", type_, const("swrl:ClassAtom"))
    add("part", where, f"{_node('w')} || 'a'", const("swrl:classPredicate"), _class())
    add("part", where, f"{_node('w')} || 'a'", const("swrl:argument1"), term("x"))
    add("part", where, f"{_node('w')} || 'b'", type_, const("swrl:IndividualPropertyAtom"))
    add("part", where, f"{_node('w')} || 'b'", const("swrl:propertyPredicate"), _prop())
    add("part", where, f"{_node('w')} || 'b'", const("swrl:argument1"), term("x"))
    add("part", where, f"{_node('w')} || 'b'", const("swrl:argument2"), term("y"))
    # Nested structured nodes, assertions about triples.
    add("part", f"{k} % 13 = 0", _class(), term("source"), _node("n"), "bnode")
    add("part", f"{k} % 13 = 0", _node("n"), term("who"), "p_brand", "literal")
    add("part", f"{k} % 13 = 0", _node("n"), term("when"), _node("m"), "bnode")
    add("part", f"{k} % 13 = 0", _node("m"), term("year"), text("1990 + p_size"), "literal")
    add("part", f"{k} % 17 = 0", _node("x"), type_, const("owl:Axiom"))
    add("part", f"{k} % 17 = 0", _node("x"), const("owl:annotatedSource"), _class())
    add("part", f"{k} % 17 = 0", _node("x"), const("owl:annotatedProperty"), label)
    add("part", f"{k} % 17 = 0", _node("x"), const("owl:annotatedTarget"), "p_name", "literal")
    add("part", f"{k} % 26 = 0", _node("m"), term("note"), "p_type", "literal")
    add("part", f"{k} % 26 = 0", _node("m"), term("note"), _node("o"), "bnode")
    add("part", f"{k} % 26 = 0", _node("o"), term("by"), named("nation", f"{k} % 25"))
    add("part", f"{k} % 26 = 0", _node("o"), term("steps"), f"{_node('o')} || '_1'", "bnode")
    out.extend(_list("part", f"{k} % 26 = 0", _node("o"), [(_class(), "iri"), (_class(f"{k} + 1"), "iri")]))
    add("part", f"{k} % 51 = 0", _node("x"), const("rdfs:comment"), "p_type", "literal", "'en'")
    add("part", f"{k} % 34 = 0", _node("xa"), type_, const("owl:Annotation"))
    add("part", f"{k} % 34 = 0", _node("xa"), const("owl:annotatedSource"), _node("x"), "bnode")
    add("part", f"{k} % 34 = 0", _node("xa"), const("owl:annotatedProperty"), const("rdfs:comment"))
    add("part", f"{k} % 34 = 0", _node("xa"), const("owl:annotatedTarget"), "p_type", "literal", "'en'")
    add("part", f"{k} % 34 = 0", _node("xa"), term("who"), "p_brand", "literal")
    for rest, target, value, kind in ((0, "owl:targetIndividual", named("nation", f"({k} + 1) % 25"), "iri"), (1, "owl:targetValue", "p_brand", "literal")):
        where = f"{k} % 19 = 0 AND {k} % 2 = {rest}"
        add("part", where, _node("v"), type_, const("owl:NegativePropertyAssertion"))
        add("part", where, _node("v"), const("owl:sourceIndividual"), named("nation", f"{k} % 25"))
        add("part", where, _node("v"), const("owl:assertionProperty"), const("owl:sameAs"))
        add("part", where, _node("v"), const(target), value, kind)
        add("part", where, _node("v"), const("rdfs:label"), "p_name", "literal")
    add("part", f"{k} % 23 = 0", _node("s"), type_, const("rdf:Statement"))
    add("part", f"{k} % 23 = 0", _node("s"), const("rdf:subject"), _class())
    add("part", f"{k} % 23 = 0", _node("s"), const("rdf:predicate"), const("rdfs:subClassOf"))
    add("part", f"{k} % 46 = 0", _node("s"), const("rdf:object"), _class(half(k, 2)))
    add("part", f"{k} % 23 = 0", _node("s"), term("who"), "p_brand", "literal")
    # Models that import each other in a tree with a way back to the root.
    add("part", f"{k} % 4 = 1", named("model", k), type_, const("owl:Ontology"))
    add("part", f"{k} % 4 = 1", named("model", k), const("owl:versionInfo"), text("p_size"), "literal")
    add("part", f"{k} % 4 = 1 AND {k} > 1", named("model", f"{half(k, 8)} * 4 + 1"), const("owl:imports"), named("model", k))
    add("part", f"{k} % 64 = 1", named("model", k), const("owl:imports"), named("model", "1"))
    # Individuals and their relations.
    for table, key, name, cls in (("region", "r_regionkey", "r_name", "Region"), ("nation", "n_nationkey", "n_name", "Nation"), ("customer", "c_custkey", "c_name", "Customer"), ("supplier", "s_suppkey", "s_name", "Supplier")):
        add(table, "true", named(table, key), type_, term(cls))
        add(table, "true", named(table, key), label, name, "literal")
    add("nation", "true", named("nation", "n_nationkey"), term("inRegion"), named("region", "n_regionkey"))
    add("nation", "n_nationkey % 3 = 0", named("nation", "n_nationkey"), const("owl:sameAs"), named("nation", "(n_nationkey + 1) % 25"))
    add("nation", "n_nationkey % 3 = 1", named("nation", "n_nationkey"), const("owl:differentFrom"), named("nation", "(n_nationkey + 1) % 25"))
    add("customer", "true", named("customer", "c_custkey"), term("inNation"), named("nation", "c_nationkey"))
    add("supplier", "true", named("supplier", "s_suppkey"), term("inNation"), named("nation", "s_nationkey"))
    add("orders", "true", named("order", "o_orderkey"), type_, term("Order"))
    add("orders", "true", named("order", "o_orderkey"), term("orderedBy"), named("customer", "o_custkey"))
    add("orders", "true", named("order", "o_orderkey"), term("status"), "o_orderstatus", "literal")
    # Orders hold their line numbers as an ordered list on an unmapped predicate.
    node = "'_:l' || CAST(l_orderkey AS STRING) || '_' || CAST({} AS STRING)"
    add("lineitem", "l_linenumber = 1", named("order", "l_orderkey"), term("items"), node.format("l_linenumber"), "bnode")
    add("lineitem", "true", node.format("l_linenumber"), const("rdf:first"), named("part", "l_partkey"))
    add("lineitem", "l_linenumber > 1", node.format("l_linenumber - 1"), const("rdf:rest"), node.format("l_linenumber"), "bnode")
    # Conversations are sequences, documents and labels describe things, events are typed by kind.
    add("conversations", "turn = 0", named("conversation", "conv_id"), type_, const("rdf:Seq"))
    add("conversations", "true", named("conversation", "conv_id"), f"'{iri('rdf:_')}' || {text('turn + 1')}", "role", "literal")
    add("events", "true", named("event", "event_id"), type_, f"'{EX}o#' || event_type")
    add("documents", "true", named("document", "doc_id"), const("skos:prefLabel"), "source", "literal", "lang")
    return out


def _thesaurus() -> list[Line]:
    """Collections, concepts and schemes, apart from the ontology: parts and documents are concepts, nations collections."""
    k = "p_partkey"
    out: list[Line] = []

    def add(table, where, s, p, o, kind="iri", lang="''"):
        out.append(Line(table, where, s, p, o, kind, lang))

    concept, collection, scheme = (lambda x=k: named("concept", x)), (lambda x: named("collection", x)), (lambda x: named("scheme", x))
    type_, other = const("rdf:type"), "'http://other.org/things#' || CAST(p_partkey AS STRING)"
    add("part", f"{k} % 9 <> 4", concept(), type_, const("skos:Concept"))
    add("part", f"{k} > 1 AND {k} % 4 <> 3", concept(), const("skos:broader"), concept(half(k, 2)))
    add("part", f"{k} % 4 = 3", concept(half(k, 2)), const("skos:narrower"), concept())
    add("part", f"{k} % 10 = 3", concept(), const("skos:related"), concept(f"{k} + 1"))
    add("part", f"{k} % 5 <> 4", concept(), const("skos:prefLabel"), "p_name", "literal", "'en'")
    add("part", f"{k} % 3 = 0", concept(), const("skos:prefLabel"), "p_brand", "literal", "'de'")
    add("part", f"{k} % 7 = 1", concept(), const("skos:altLabel"), "p_type", "literal", "'en-GB'")
    add("part", f"{k} % 4 <> 1", concept(), const("skos:definition"), "p_type", "literal", "'en'")
    add("part", f"{k} % 6 = 0", concept(), const("skos:definition"), "p_brand", "literal", "'de'")
    add("part", f"{k} % 8 = 1", concept(), const("skos:definition"), "p_name", "literal")
    add("part", f"{k} % 13 = 0", concept(), const("skos:notation"), text(k), "literal")
    for rest, (p, o) in enumerate((("skos:exactMatch", other), ("skos:closeMatch", concept(f"{k} + 1")), ("skos:broadMatch", other), ("skos:narrowMatch", concept(f"{k} + 5")), ("skos:relatedMatch", other))):
        add("part", f"{k} % 12 = {rest}", concept(), const(p), o)
    add("part", "true", concept(), const("skos:inScheme"), scheme(f"{k} % 5"))
    add("documents", "true", concept("'d' || CAST(doc_id AS STRING)"), type_, const("skos:Concept"))
    add("documents", "true", concept("'d' || CAST(doc_id AS STRING)"), const("skos:definition"), "source", "literal", "lang")
    add("documents", "true", collection("0"), const("skos:member"), concept("'d' || CAST(doc_id AS STRING)"))
    add("region", "true", scheme("r_regionkey"), type_, const("skos:ConceptScheme"))
    add("region", "true", scheme("r_regionkey"), const("skos:prefLabel"), "r_name", "literal", "'en'")
    add("region", "true", scheme("r_regionkey"), const("skos:hasTopConcept"), concept("r_regionkey + 1"))
    add("region", "true", scheme("r_regionkey"), const("rdfs:seeAlso"), "'https://w3id.org/about/' || r_name")
    add("nation", "true", scheme("n_regionkey"), term("covers"), "n_name", "literal", "CASE WHEN n_nationkey % 2 = 0 THEN 'en' ELSE 'fr' END")
    add("nation", "n_nationkey % 5 <> 0", collection("n_nationkey"), type_, const("skos:Collection"))
    add("nation", "n_nationkey % 5 = 0", collection("n_nationkey"), type_, const("skos:OrderedCollection"))
    add("nation", "n_nationkey % 5 = 1", collection("n_nationkey"), const("skos:member"), collection("n_nationkey + 1"))
    add("nation", "true", collection("n_nationkey"), const("skos:prefLabel"), "n_name", "literal", "'en'")
    add("supplier", "true", collection("s_nationkey"), const("skos:member"), concept("s_suppkey"))
    return out


SPECIFICATION = _specification()
THESAURUS = _thesaurus()


def _chosen(predicates: list[str] | None, specification: list[Line] | None = None) -> list[Line]:
    wanted = None if predicates is None else {f"'{iri(p)}'" for p in predicates}
    return [x for x in (SPECIFICATION if specification is None else specification) if (wanted is None or x.p in wanted or ("||" in x.p and any(w.startswith(x.p.split("' ||")[0]) for w in wanted)))]


def _kind(s: str) -> str:
    return "'bnode'" if s.startswith("'_:") else "'iri'"


def lift(spark: SparkSession, sf_dir: str, predicates: list[str] | None = None, specification: list[Line] | None = None) -> DataFrame:
    """Triples of the tables in ``sf_dir``: s, s_kind, p, o, o_kind, o_lang, o_dt (empty: none)."""
    parts = []
    lines = _chosen(predicates, specification)
    groups: dict[str, list[Line]] = {}
    for line in lines:
        groups.setdefault(line.table, []).append(line)
    for line in (x for own in groups.values() if len(own) <= FEW_LINES for x in own):
        terms = [f"{x} AS {name}" for name, x in (("s", line.s), ("s_kind", _kind(line.s)), ("p", line.p), ("o", line.o), ("o_kind", f"'{line.kind}'"), ("o_lang", line.lang), ("o_dt", "''"))]
        parts.append(spark.read.parquet(f"{sf_dir}/{line.table}.parquet").where(line.where).selectExpr(*terms))
    groups = {t: own for t, own in groups.items() if len(own) > FEW_LINES}
    for table, made in ((t, own[i : i + LINES]) for t, own in groups.items() for i in range(0, len(own), LINES)):
        made = [f"CASE WHEN {x.where} THEN named_struct('s', {x.s}, 's_kind', {_kind(x.s)}, 'p', {x.p}, 'o', {x.o}, 'o_kind', '{x.kind}', 'o_lang', {x.lang}, 'o_dt', '') END" for x in made]
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        parts.append(rows.select(F.explode(F.expr(f"array({', '.join(made)})")).alias("t")).where("t is not null").select("t.*"))
    return reduce(DataFrame.unionByName, parts)


def lift_sql(predicates: list[str] | None = None, specification: list[Line] | None = None) -> str:
    """The same triples as plain SQL."""
    lines = [f"SELECT {x.s} AS s, {_kind(x.s)} AS s_kind, {x.p} AS p, {x.o} AS o, '{x.kind}' AS o_kind, {x.lang} AS o_lang, '' AS o_dt FROM {x.table} WHERE {x.where}" for x in _chosen(predicates, specification)]
    return " UNION ALL ".join(lines)
