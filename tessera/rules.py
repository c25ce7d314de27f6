"""Class lattice and rule tables: which predicate or type makes which entity, and what it fills in."""

from __future__ import annotations

import functools
import json
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from .vocab import DIALECT_NAMESPACES, PREFIXES, iri

# Entity class and its parent.
PARENTS = {
    "Resource": None, "Property": "Resource", "Relation": "Property", "Attribute": "Property", "Annotation": "Property",
    "Literal": "Resource", "Concept": "Resource", "Datatype": "Concept", "Restriction": "Concept", "TruthFunction": "Restriction",
    "OneOf": "Restriction", "PropertyConceptRestriction": "Restriction", "Quantifier": "PropertyConceptRestriction",
    "Cardinality": "PropertyConceptRestriction", "Value": "Restriction", "DatatypeRestriction": "Restriction",
    "PropertySelfRestriction": "Restriction", "Model": "Resource", "Individual": "Resource", "Statement": "Resource",
    "Container": "Resource", "Collection": "Resource", "Variable": "Resource", "Atom": "Resource", "Rule": "Resource",
}

# Of several classes of one IRI, the first in this order is the dominant one.
PUNNING_PRIORITY = ["Model", "Individual", "Concept", "Relation", "Attribute", "Annotation", "Property", "Datatype"]

# Name | class or predicate | target classes | inferred class | handler | setters.
BASE_RULES = """
rdfs:Literal | class | Literal
rdfs:Datatype | class | Datatype
rdf:Property | class | Property
rdfs:domain | predicate | Property | | | has_domain=Concept
rdfs:range | predicate | Property | | | has_range=Resource
rdfs:subPropertyOf | predicate | Property | Property | | is_sub_property_of=Property
rdfs:subClassOf | predicate | Concept | Concept | | is_sub_concept_of=Concept
rdfs:Class | class | Concept
rdfs:Resource | class | Resource
rdfs:label | predicate | Resource | | | has_label=Literal
rdfs:comment | predicate | Resource | | | has_comment=Literal
rdfs:seeAlso | predicate | Resource | | | see_also=Resource
rdfs:isDefinedBy | predicate | Resource | | | is_defined_by=Resource
rdf:type | predicate | Individual, Resource | | | has_type=Concept
swrl:Variable | class | Variable
swrl:Imp | class | Rule
swrl:ClassAtom | class | Atom
swrl:IndividualPropertyAtom | class | Atom
swrl:DatavaluedPropertyAtom | class | Atom
swrl:SameIndividualAtom | class | Atom
swrl:DifferentIndividualsAtom | class | Atom
swrl:BuiltinAtom | class | Atom
swrl:DataRangeAtom | class | Atom
swrl:arguments | predicate | Atom
swrl:argument1 | predicate | Atom | | | has_argument1=Resource
swrl:argument2 | predicate | Atom | | | has_argument2=Resource
swrl:classPredicate | predicate | Atom | | | has_predicate=Concept
swrl:propertyPredicate | predicate | Atom | | | has_predicate=Property
swrl:builtin | predicate | Atom | | | has_predicate=Annotation
swrl:dataRange | predicate | Atom | | | has_predicate=Datatype
swrl:body | predicate | Rule
swrl:head | predicate | Rule
"""

# The same for the OWL vocabulary.
OWL_RULES = """
rdf:type | predicate | Individual, Resource | | rdf_type
rdfs:Literal | class | Literal
owl:ObjectProperty | class | Relation
owl:DatatypeProperty | class | Attribute
owl:AnnotationProperty | class | Annotation
owl:OntologyProperty | class | Property
owl:DeprecatedProperty | class | Property
owl:Thing | class | Individual
owl:AsymmetricProperty | class | Relation | | | is_asymmetric=True
owl:SymmetricProperty | class | Relation | | | is_symmetric=True
owl:FunctionalProperty | class | Property | | | is_functional=True
owl:InverseFunctionalProperty | class | Relation | | | is_inverse_functional=True
owl:TransitiveProperty | class | Relation | | | is_transitive=True
owl:IrreflexiveProperty | class | Relation | | | is_irreflexive=True
owl:ReflexiveProperty | class | Relation | | | is_reflexive=True
owl:NegativePropertyAssertion | class | Statement | | | is_positive_statement=False
owl:DataRange | class | Datatype
owl:Ontology | class | Model
skos:ConceptScheme | class | Model
owl:NamedIndividual | class | Individual
owl:Annotation | class | Statement
owl:sourceIndividual | predicate | Statement | | | has_subject=Individual
owl:targetIndividual | predicate | Statement | | | has_object=Individual
owl:targetValue | predicate | Statement | | | has_object=Literal
rdfs:domain | predicate | Property | | domain
rdfs:range | predicate | Property | | range
owl:propertyDisjointWith | predicate | Property | Property | symmetric:is_disjoint_with
owl:equivalentProperty | predicate | Property | Property | symmetric:is_equivalent_to
owl:disjointWith | predicate | Concept | Concept | symmetric:is_disjoint_with
owl:disjointUnionOf | predicate | Concept | Concept | disjoint_union
owl:equivalentClass | predicate | Concept | Concept | symmetric:is_equivalent_to
owl:imports | predicate | Model | Model | | imports=Model
owl:versionIRI | predicate | Model | Model | | has_version=Model
owl:priorVersion | predicate | Model | Model | | has_prior_version=Model
owl:backwardCompatibleWith | predicate | Model | Model | | is_backward_compatible_with=Model
owl:incompatibleWith | predicate | Model | Model | | is_incompatible_with=Model
owl:hasKey | predicate | Concept | | has_key
owl:annotatedProperty | predicate | Statement | | | has_predicate=Property
owl:annotatedSource | predicate | Statement | | | has_subject=Resource
owl:annotatedTarget | predicate | Statement | | | has_object=Resource
owl:assertionProperty | predicate | Statement | | | has_predicate=Property
skos:Concept | class | Concept
owl:Class | class | Concept
rdfs:Class | class | Concept
owl:DeprecatedClass | class | Concept | | | is_deprecated=True
owl:versionInfo | predicate | Resource | | | has_version_info=Resource
owl:deprecated | predicate | Resource | | | is_deprecated=True
owl:Axiom | class | Statement
owl:Restriction | class | Restriction
owl:withRestrictions | predicate | DatatypeRestriction | DatatypeRestriction | facets
owl:hasSelf | predicate | PropertySelfRestriction | PropertySelfRestriction
owl:inverseOf | predicate | Relation, Restriction | Relation | symmetric:is_inverse_of
owl:propertyChainAxiom | predicate | Relation | Relation | property_chain
owl:intersectionOf | predicate | TruthFunction, Concept | TruthFunction | truth:and
owl:unionOf | predicate | TruthFunction, Concept | TruthFunction | truth:or
owl:complementOf | predicate | TruthFunction, Concept | TruthFunction | truth:not
owl:hasValue | predicate | Value | Value | has_value
owl:oneOf | predicate | OneOf, Concept | OneOf | one_of
owl:someValuesFrom | predicate | Quantifier | Quantifier | | has_quantifier_type=some, applies_on_concept=Concept
owl:allValuesFrom | predicate | Quantifier | Quantifier | | has_quantifier_type=only, applies_on_concept=Concept
owl:cardinality | predicate | Cardinality | Cardinality | cardinality:exactly
owl:minCardinality | predicate | Cardinality | Cardinality | cardinality:min
owl:maxCardinality | predicate | Cardinality | Cardinality | cardinality:max
owl:qualifiedCardinality | predicate | Cardinality | Cardinality | cardinality:exactly
owl:minQualifiedCardinality | predicate | Cardinality | Cardinality | cardinality:min
owl:maxQualifiedCardinality | predicate | Cardinality | Cardinality | cardinality:max
owl:onProperty | predicate | Restriction | | on_property
owl:onClass | predicate | Restriction | | | applies_on_concept=Concept
owl:onDatatype | predicate | DatatypeRestriction, Datatype | DatatypeRestriction | | is_sub_concept_of=Datatype
owl:onDataRange | predicate | Restriction | | | applies_on_concept=Datatype
owl:sameAs | predicate | Resource | Individual | symmetric:is_same_as
owl:differentFrom | predicate | Resource | | symmetric:is_different_from
"""

# The same for the RDF vocabulary.
RDF_RULES = """
rdf:Property | class | Property
rdf:Statement | class | Statement
rdf:subject | predicate | Statement | | | has_subject=Resource
rdf:predicate | predicate | Statement | | | has_predicate=Resource
rdf:object | predicate | Statement | | | has_object=Resource
rdf:Bag | class | Container | | container
rdf:Alt | class | Container | | container
rdf:List | class | Container | | container
rdf:Seq | class | Container | | container
"""

# The same for the SKOS vocabulary.
SKOS_RULES = """
skos:Concept | class | Concept
skos:ConceptScheme | class | Model
skos:Collection | class | Collection
skos:OrderedCollection | class | Collection | | | is_ordered=True
skos:prefLabel | predicate | Resource | | | has_preferred_label=Literal
skos:altLabel | predicate | Resource | | | has_alternative_label=Literal
skos:hiddenLabel | predicate | Resource | | | has_hidden_label=Literal
skos:notation | predicate | Resource | | | has_notation=Literal
skos:note | predicate | Resource | | | has_note=Literal
skos:changeNote | predicate | Resource | | | has_change_note=Literal
skos:definition | predicate | Resource | | | has_definition=Literal
skos:editorialNote | predicate | Resource | | | has_editorial_note=Literal
skos:example | predicate | Resource | | | has_example=Literal
skos:historyNote | predicate | Resource | | | has_history_note=Literal
skos:scopeNote | predicate | Resource | | | has_scope_note=Literal
skos:broader | predicate | Concept | Concept | | is_sub_concept_of=Concept
skos:narrower | predicate | Concept | Concept | narrower
skos:related | predicate | Concept | Concept | symmetric:is_related_to
skos:broadMatch | predicate | Concept | Concept | | has_broad_match=Concept
skos:narrowMatch | predicate | Concept | Concept | | has_narrow_match=Concept
skos:exactMatch | predicate | Concept | Concept | | has_exact_match=Concept
skos:closeMatch | predicate | Concept | Concept | | has_close_match=Concept
skos:relatedMatch | predicate | Concept | Concept | | has_related_match=Concept
skos:inScheme | predicate | Resource | | | is_included_in=Model
skos:hasTopConcept | predicate | Model | Model | | has_top_concept=Concept
skos:member | predicate | Collection | Collection | | has_member=Resource
"""

ENRICHERS = {"owl:AllDisjointClasses": "is_disjoint_with", "owl:AllDifferent": "is_different_from", "owl:AllDisjointProperties": "is_disjoint_with", "swrl:Imp": "rule"}
DIALECTS = {"owl": OWL_RULES, "rdf": RDF_RULES, "skos": SKOS_RULES}
#: Dialects that were read from files.
ADDED: dict[str, dict] = {}


# What operators know how to do with a predicate or type; ``symmetric``, ``truth`` and ``cardinality`` take an argument.
HANDLERS = {"rdf_type", "domain", "range", "symmetric", "disjoint_union", "has_key", "facets", "property_chain", "truth", "has_value", "one_of", "cardinality", "on_property", "container", "narrower"}


class Rule(NamedTuple):
    ord: int
    name: str
    kind: str
    targets: list[str]
    inferred: str | None
    handler: str | None
    setters: dict[str, str]


@functools.cache
def lattice() -> dict[str, dict[str, int]]:
    """class -> its ancestors, itself included, with their distance."""
    out = {}
    for name in PARENTS:
        chain, above = {}, name
        while above is not None:
            chain[above] = len(chain)
            above = PARENTS[above]
        out[name] = chain
    return out


def is_sub(a: str, b: str) -> bool:
    return b in lattice()[a]


def merged(base: dict, override: dict) -> dict:
    """Maps go together key by key, at any depth; lists and plain values are replaced, by empty ones too. What an
    override says about itself (``name``, ``inherits``) isn't taken over."""
    out = dict(base)
    for key, value in override.items():
        if key in ("name", "inherits"):
            continue
        before = out.get(key)
        out[key] = merged(before, value) if isinstance(before, dict) and isinstance(value, dict) else value
    return out


def _table(text: str) -> dict[str, dict]:
    """A table as configuration: what is empty is not said, and so inherited."""
    out = {}
    for line in text.strip().splitlines():
        name, kind, targets, inferred, handler, setters = ([f.strip() for f in line.split("|")] + [""] * 5)[:6]
        said = {"targets": [t.strip() for t in targets.split(",") if t.strip()], "inferred": inferred, "handler": handler, "setters": [dict([x.strip().split("=")]) for x in setters.split(",") if x.strip()]}
        out[name] = {"is": kind, **{k: v for k, v in said.items() if v}}
    return out


def config(dialect: str) -> dict:
    """Namespaces and mapper of a dialect as a nested map, which ``merged`` can go on from.

    Raises ValueError for a dialect that isn't there.
    """
    name = dialect.lower()
    if name in ADDED:
        return ADDED[name]
    if name not in DIALECTS:
        raise ValueError(f"no dialect {dialect!r}; there are {sorted({*DIALECTS, *ADDED})}")
    return {"namespaces": [PREFIXES[p] for p in DIALECT_NAMESPACES[name]], "mapper": merged(_table(BASE_RULES), _table(DIALECTS[name]))}


def _setter(entry: dict | str) -> tuple[str, str]:
    """``{set_has_label: Literal}`` -> (has_label, Literal); a name alone takes any resource."""
    (name, value), *_ = entry.items() if isinstance(entry, dict) else [(entry, "Resource")]
    return name.removeprefix("set_"), str(value)


def _rule(place: int, name: str, said: dict) -> Rule:
    targets = said.get("targets") or said.get("target_classes") or [c for c in [said.get("target_class")] if c]
    inferred, handler = said.get("inferred", said.get("inferred_class")) or None, said.get("handler") or None
    for c in [*targets, *([inferred] if inferred else [])]:
        PARENTS[c]  # an unknown class is an error in the table
    if handler and handler.split(":")[0] not in HANDLERS:
        raise ValueError(f"no handler {handler!r} for {name}")
    return Rule(place, iri(name), said["is"], list(targets), inferred, handler, dict(map(_setter, said.get("setters") or [])))


def _rules(mapper: dict[str, dict]) -> tuple[Rule, ...]:
    """The rules of a mapper in its order; an entry that is neither class nor predicate rules nothing."""
    return tuple(_rule(k, name, said) for k, (name, said) in enumerate(mapper.items()) if said.get("is"))


@functools.cache
def rules(dialect: str) -> tuple[Rule, ...]:
    """Base and dialect rules merged by name: a name keeps its base position, the dialect's fields win.

    Raises ValueError for a dialect or handler that isn't there and KeyError for an unknown entity class.
    """
    return _rules(config(dialect)["mapper"])


def read_config(path: str) -> dict:
    """A rule file: JSON, or YAML where its library is there. Raises ValueError for what is no map."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    if path.lower().endswith((".yaml", ".yml")):
        import yaml

        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path} is no map of rules")
    return found


def add_dialect(name: str, *paths: str, like: str | None = None) -> tuple[Rule, ...]:
    """Rules from files, each merged onto those before it and the first onto the dialect ``like``, if there is one.

    The new dialect is read like any other; a name that is there already (its own name as ``like``, say) is replaced
    until ``remove_dialect``. Errors of the files are raised here, and nothing is added then.
    """
    made = config(like) if like else {"namespaces": [], "mapper": {}}
    for path in paths:
        made = merged(made, read_config(path))
    made = {"namespaces": list(made.get("namespaces") or []), "mapper": made.get("mapper") or {}}
    out = _rules(made["mapper"])
    ADDED[name.lower()] = made
    rules.cache_clear()
    return out


def remove_dialect(name: str) -> None:
    ADDED.pop(name.lower(), None)
    rules.cache_clear()


def predicate_rules(dialect: str = "owl") -> list[Rule]:
    return [r for r in rules(dialect) if r.kind == "predicate"]


def type_rules(dialect: str = "owl") -> list[Rule]:
    return [r for r in rules(dialect) if r.kind == "class"]


def namespaces(dialect: str) -> list[str]:
    return config(dialect)["namespaces"]


# Rule tables as frames; they are of fixed size, whatever the data.


def predicate_frame(spark: SparkSession, dialect: str = "owl") -> DataFrame:
    rows = [(r.name, r.ord, r.inferred, r.targets[0] if len(r.targets) == 1 else None, r.targets, r.handler, bool(r.handler or r.setters)) for r in predicate_rules(dialect)]
    return spark.createDataFrame(rows, "p string, ord int, inferred string, single string, targets array<string>, handler string, acts boolean")


def type_frame(spark: SparkSession, dialect: str = "owl") -> DataFrame:
    return spark.createDataFrame([(r.name, r.ord, r.targets[0]) for r in type_rules(dialect)], "o string, ord int, cls string")


def setter_rows(dialect: str = "owl") -> list[tuple[bool, str, str, str | None]]:
    """is_type, name, attr, constant of all that rules set without a handler; no constant: the object of the triple.

    Literals and rdf:type are left out: they have conditions of their own.
    """
    out = [(False, r.name, attr, None if kind in PARENTS else kind) for r in predicate_rules(dialect) if not r.handler and r.name != iri("rdf:type") for attr, kind in r.setters.items() if kind != "Literal"]
    return out + [(True, r.name, attr, constant) for r in type_rules(dialect) for attr, constant in r.setters.items()]


def setter_frame(spark: SparkSession, dialect: str = "owl") -> DataFrame:
    return spark.createDataFrame(setter_rows(dialect), "is_type boolean, name string, attr string, constant string")


#: What a rule can ask for besides a class: a datatype of attributes and else a concept, or the class of the subject.
RANGE, OWN = "range", "own"
#: Handlers whose list items are asked for: class, and whether only nodes without a class are.
LIST_REQUESTS = {"has_key": ("Property", True), "property_chain": ("Relation", True), "one_of": ("Individual", False), "disjoint_union": ("Concept", False), "truth": ("Concept", False)}


def request_rows(dialect: str = "owl") -> list[tuple[str, int, str, bool, bool, bool, bool]]:
    """p, ord, asks, listed, iri_only, new_only, free: the classes that rules ask their values, or list items, to have.
    ``free``: terms of the vocabularies themselves aren't asked for."""
    out = []
    for r in predicate_rules(dialect):
        handler, _, detail = (r.handler or "").partition(":")
        if not handler:
            out += [(r.name, r.ord, kind, False, False, False, False) for kind in r.setters.values() if kind in PARENTS and kind != "Literal"]
        elif handler in LIST_REQUESTS and detail != "not":
            asks, new_only = LIST_REQUESTS[handler]
            out.append((r.name, r.ord, asks, True, False, new_only, False))
        elif handler == "symmetric" and detail in ("is_same_as", "is_different_from") or handler == "has_value":
            out.append((r.name, r.ord, "Individual", False, False, False, False))
        elif handler == "symmetric" and detail == "is_inverse_of" or handler == "on_property":
            out.append((r.name, r.ord, "Relation", False, True, handler == "on_property", False))
        elif handler == "symmetric" and r.targets == ["Property"]:
            out.append((r.name, r.ord, OWN, False, False, True, False))
        elif handler == "range":
            out.append((r.name, r.ord, RANGE, False, False, False, False))
        elif handler in ("domain", "rdf_type", "symmetric", "narrower", "truth"):
            out.append((r.name, r.ord, "Concept", False, False, False, handler == "rdf_type"))
    return out


def request_frame(spark: SparkSession, dialect: str = "owl") -> DataFrame:
    return spark.createDataFrame(request_rows(dialect), "p string, ord int, asks string, listed boolean, iri_only boolean, new_only boolean, free boolean")


def lattice_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b, d) for a, up in lattice().items() for b, d in up.items()], "sub string, sup string, depth int")


def below(name: str) -> list[str]:
    """The class and all its subclasses."""
    return [c for c in PARENTS if is_sub(c, name)]
