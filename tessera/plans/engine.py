"""The extraction lifecycle: triples -> entities -> values, statements, warnings -> views and exports."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import clean_name, local_name
from ..operators import axioms, classify, populate, quality, retract, statements
from ..operators.closure import list_items, materialize
from ..operators.patterns import of_class
from ..sinks.serialize import serialized
from ..sources import imports as modules
from ..sources import parse
from ..sources.namespaces import read_namespaces
from ..sources.validate import ArtefactLoadError
from . import cards, skos, values, views


class Ontology:
    """An artefact, or many, read as ``owl``, ``rdf`` or ``skos``. Every property is a DataFrame, built when asked for."""

    def __init__(self, triples: DataFrame, dialect: str = "owl", warnings: bool = False, namespaces: DataFrame | None = None):
        """``namespaces``: prefix and uri as the artefact declares them, for its metadata."""
        rules.rules(dialect)  # an unknown dialect is an error here
        self.dialect, self.with_warnings, self.namespaces = dialect.lower(), warnings, namespaces
        self.triples = materialize(triples.select("s", "s_kind", "p", "o", "o_kind", "o_lang", "o_dt").dropDuplicates())

    @classmethod
    def load(cls, spark: SparkSession, source: str, dialect: str = "owl", imported: bool = False, closure: bool = False, catalogue: DataFrame | None = None, warnings: bool = False) -> Ontology:
        """A path that Spark can list, or an http(s) url.

        ``catalogue`` (model and triples) holds what imports refer to; with both flags the closure comes
        first, then one level more.
        """
        namespaces = None
        if source.startswith(("http://", "https://")):
            from ..sources.fetch import fetch

            triples = spark.createDataFrame([(source, *t) for t in parse.own_bnodes(source, fetch(source))], parse.SCHEMA)
        else:
            read = parse.read_rdf(spark, source)
            triples = parse.readable(read)
            if triples.isEmpty():
                reason = parse.unreadable(read).first()
                raise ArtefactLoadError(reason["reason"] if reason else "Empty artefact", path=source)
            namespaces = read_namespaces(spark, source).groupBy("prefix").agg(F.min("uri").alias("uri"))
        return cls.over(triples.drop("doc"), dialect, imported, closure, catalogue, warnings, namespaces)

    @classmethod
    def over(cls, triples: DataFrame, dialect: str = "owl", imported: bool = False, closure: bool = False, catalogue: DataFrame | None = None, warnings: bool = False, namespaces: DataFrame | None = None) -> Ontology:
        """Triples that are there already, with what they import from the ``catalogue``."""
        if catalogue is not None:
            for wanted, closed in ((closure, True), (imported, False)):
                if wanted:
                    triples = modules.with_imports(triples, catalogue, closed=closed)
        return cls(triples, dialect, warnings, namespaces)

    @cached_property
    def lists(self) -> DataFrame:
        return materialize(list_items(self.triples))

    @cached_property
    def classified(self) -> DataFrame:
        """id, id_kind, cls: nodes classified by predicates and types, then the values they refer to, with generic
        properties replaced by what they turn out to be."""
        first = materialize(classify.entities(self.triples, self.dialect))
        filling = values.scoped(self.triples, first, self.dialect)
        asked = materialize(classify.population_requests(filling, first, self.lists, self.dialect))
        found = materialize(classify.entities(self.triples, self.dialect, asked))
        if self.dialect != "owl":
            return found
        typed = classify.property_types(self.triples, found)
        concrete = of_class(found, "Property").where("cls <> 'Property'").select("id").distinct()
        unions = axioms.disjoint_unions(self.triples, self.lists).select(F.col("node").alias("id"), F.lit("bnode").alias("id_kind"), F.lit("TruthFunction").alias("cls"))
        rest = found.where("cls <> 'Property'").unionByName(unions)
        again = typed.select(F.col("prop").alias("id"), F.lit("iri").alias("id_kind"), "cls").join(concrete, "id", "left_anti")
        return materialize(rest.unionByName(again).distinct())

    @cached_property
    def retracted(self) -> DataFrame:
        """id, round: restrictions without a property, and what can't be stated without them."""
        return materialize(retract.retracted(self.triples, self.lists, self.classified))

    @cached_property
    def entities(self) -> DataFrame:
        """id, id_kind, cls of ``classified`` without what is taken back, with the nodes of truth functions and all that only
        statements mention."""
        made = statements.made_entities(self.triples, self.classified, self.statements, self.nested_parts)
        found = self.classified.unionByName(made).distinct()
        if self.dialect != "owl":
            return materialize(found)
        truths = retract.truth_values(self.triples, self.lists, self.classified, self.retracted)
        return materialize(found.join(self.retracted.select("id"), "id", "left_anti").unionByName(retract.truth_nodes(truths, self.classified)))

    @cached_property
    def values(self) -> DataFrame:
        """id, attr, ord, v, lang in long form: literals, setters, lists, restrictions, axioms, rules, domains and ranges."""
        found = values.stated(self.triples, self.lists, self.classified, self.dialect, self.retracted if self.dialect == "owl" else None)
        found = found.unionByName(values.of_lists(self.statements, self.lists))
        return found.unionByName(values.of_entities(self.triples, self.entities, self.dialect)).distinct()

    @cached_property
    def statements(self) -> DataFrame:
        return materialize(statements.statements(self.triples, self.classified, self.dialect))

    @cached_property
    def nested_parts(self) -> DataFrame:
        return materialize(statements.nested_parts(self.triples, self.classified, self.lists, self.dialect))

    @cached_property
    def nested_values(self) -> DataFrame:
        """id, path, v, kind of structured nodes with all that hangs below them."""
        return statements.nested_values(self.nested_parts)

    @cached_property
    def annotations(self) -> DataFrame:
        """s, p, o, attr, v, v_lang, is_positive: what reified axioms and statements say about their triples."""
        return statements.triple_annotations(self.triples)

    @cached_property
    def nested(self) -> DataFrame:
        return statements.nested_statements(self.triples, self.classified, self.dialect)

    @cached_property
    def warnings(self) -> DataFrame:
        """code, subject, message; empty unless they were asked for."""
        found = quality.all_warnings(self.triples, self.lists, self.classified, self.dialect)
        return found if self.with_warnings else found.limit(0)

    @cached_property
    def provenance(self) -> DataFrame:
        return statements.provenance(self.triples, populate.list_values(self.triples, self.lists, *_members()))

    def instances(self, uri: str | None = None, cls: str | None = None) -> DataFrame:
        found = self.entities if uri is None else self.entities.where(F.col("id") == uri)
        return found if cls is None else of_class(found, cls)

    def cards(self, language: str = "en") -> DataFrame:
        return views.entity_cards(self.triples, self.entities, language)

    def view(self, language: str | None = "en") -> DataFrame:
        return views.grouped_view(self.cards(language or "en"), self.dialect)

    def resources(self, asked: DataFrame, language: str = "en") -> DataFrame:
        """Cards of the resources ``asked`` for (uri); those that aren't there have an error instead."""
        return views.resources_view(self.cards(language), asked)

    def labels(self, language: str | None = "en") -> DataFrame:
        """id, label of all entities."""
        return views.best_labels(self.triples, self.entities, language or "en")

    def metadata(self, language: str | None = None) -> DataFrame:
        """rank, name, text, link, is_visualizable of the first model: values, statements and prefixes."""
        return views.metadata_view(self.entities, self.relations(language), self.statements, self.labels(language), language, self.namespaces)

    def concept_cards(self, language: str | None = "en") -> DataFrame:
        return skos.concept_cards(self.entities, self.values, self.labels(language), language)

    def semantic_sections(self, language: str | None = "en") -> DataFrame:
        return skos.semantic_sections(self.entities, self.values, self.labels(language))

    def other_relations(self, language: str | None = None) -> DataFrame:
        return skos.other_relations(self.entities, self.values, language)

    def relations(self, language: str | None = "en") -> DataFrame:
        """id, rank, name, ord, text, link, lang, kind, is_deprecated: what cards show, see ``cards.relations``."""
        texts = views.restriction_texts(self.triples, self.lists)
        nodes = cards.known_nodes(self.triples, self.entities, texts, self.nested_values, language or "en")
        return cards.relations(self.values, nodes, language, self.dialect)

    def to_json(self, uri: str | None = None) -> DataFrame:
        """id, piece, json of one entity, or of all."""
        only = lambda df, c: df if uri is None else df.where(F.col(c) == uri)
        return cards.instance_json(only(self.triples, "s"), only(self.entities, "id"), only(self.values, "id"))

    def page_values(self, language: str | None = None) -> DataFrame:
        """uri, name, text of what a page shows: resolved values in the language, and statements."""
        rows = self.relations(language).select(F.col("id").alias("uri"), "name", "text")
        return rows.unionByName(self.statements.select(F.col("s").alias("uri"), clean_name(local_name(F.col("p"))).alias("name"), F.col("o").alias("text")))

    def export(self, uri: str | None = None, fmt: str = "ttl") -> DataFrame:
        """root, text: the subgraph of a resource, or of every resource."""
        columns = ["root", "s", "s_kind", "p", "o", "o_kind", "o_lang", "o_dt"]
        part = self.provenance if uri is None else self.provenance.where(F.col("root") == uri)
        return serialized(part.join(self.triples, ["s", "p", "o"]).select(*columns), fmt)


def _members() -> list[str]:
    return ["owl:members", "owl:distinctMembers"]
