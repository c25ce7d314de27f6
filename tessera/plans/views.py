"""Documentation views: labels, sections, entities, restriction texts, hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import anchor, clean_name, local_name
from ..operators.closure import closure, materialize
from ..operators.ordering import numbered, spanning_forest
from ..operators.patterns import match, with_predicates
from ..operators.populate import cardinalities, facets, has_values, list_values, on_property, quantifiers, truth_functions
from ..rules import PARENTS
from ..vocab import iri

# Table of contents of each dialect's view.
SECTIONS = {"owl": ["Annotation", "Concept", "Relation", "Attribute", "Individual"], "rdf": ["Concept", "Property", "Container"], "skos": ["Collection", "Concept"]}

# Marks of urls that are likely ontologies.
EXTENSIONS = [".owl", ".rdf", ".ttl", ".nt", ".n3", ".jsonld"]
REGISTRIES = ["w3id.org", "purl.org", "xmlns.com"]
W3C_CORE = ["/1999/02/22-rdf-syntax-ns", "/2000/01/rdf-schema", "/2002/07/owl"]
KEYWORDS = ["ontology", "vocab", "schema", "skos", "foaf", "crm", "cidoc"]


def best_labels(triples: DataFrame, ids: DataFrame, language: str = "en") -> DataFrame:
    """id, label: a preferred label in the language, a label in it, the first preferred label by language tag,
    the first label, else the cleaned local name. Ties go by tag and value."""
    preferred = F.col("p") == iri("skos:prefLabel")
    fits = F.lower("o_lang").startswith(language.lower())
    tier = F.when(fits & preferred, 0).when(fits, 1).when(preferred, 2).otherwise(3)
    best = with_predicates(triples, "skos:prefLabel", "rdfs:label").where("o_kind = 'literal'").groupBy(F.col("s").alias("id")).agg(F.min(F.struct(tier.alias("tier"), "o_lang", F.col("o").alias("label"))).alias("m"))
    return ids.select("id").distinct().join(best, "id", "left").select("id", F.coalesce("m.label", clean_name(local_name(F.col("id")))).alias("label"))


def in_language(values: DataFrame, language: str | None) -> DataFrame:
    """Literals without a tag, or whose tag starts with the language."""
    return values if language is None else values.where((F.col("lang") == "") | F.lower("lang").startswith(language.lower()))


def literal_pick(values: DataFrame, language: str) -> DataFrame:
    """id, attr, v: a value in exactly the language, else the first by tag and value."""
    best = F.min(F.struct((F.lower("lang") != language.lower()).alias("other"), "lang", "v"))
    return values.groupBy("id", "attr").agg(best.alias("m")).select("id", "attr", F.col("m.v").alias("v"))


def link_anchors(cards: DataFrame) -> DataFrame:
    """uri, anchor_id: where a link to a resource goes, the card of its first class by name."""
    return cards.groupBy("uri").agg(F.min(F.struct("cls", "anchor_id")).alias("m")).select("uri", "m.anchor_id")


def contents(dialect: str) -> list[str]:
    """The sections of a dialect's view; a dialect of one's own has all classes but literals."""
    return SECTIONS.get(dialect) or sorted(c for c in PARENTS if c != "Literal")


def section_counts(found: DataFrame, dialect: str = "owl") -> DataFrame:
    """section, n in the order of the dialect's table of contents; empty sections are left out."""
    return found.where(F.col("cls").isin(contents(dialect))).groupBy(F.col("cls").alias("section")).agg(F.count("*").alias("n"))


def deprecated(triples: DataFrame) -> DataFrame:
    """id, is_deprecated of what is marked so, by a value or by its type."""
    marked = match(triples, p="owl:deprecated").select(F.col("s").alias("id")).unionByName(match(triples, p="rdf:type", o="owl:DeprecatedClass").select(F.col("s").alias("id")))
    return marked.distinct().withColumn("is_deprecated", F.lit(True))


def entity_cards(triples: DataFrame, found: DataFrame, language: str = "en") -> DataFrame:
    """anchor_id, cls, uri, label, is_deprecated of everything that is no literal."""
    labels = best_labels(triples, found, language)
    return found.where("cls <> 'Literal'").join(labels, "id").join(deprecated(triples), "id", "left").select(anchor(F.col("id"), F.col("cls")).alias("anchor_id"), "cls", F.col("id").alias("uri"), "label", F.coalesce("is_deprecated", F.lit(False)).alias("is_deprecated"))


def grouped_view(cards: DataFrame, dialect: str = "owl") -> DataFrame:
    """section and its cards, sorted by label; a section's cards are rows that a site writer can split further."""
    return cards.where(F.col("cls").isin(contents(dialect))).select(F.col("cls").alias("section"), *cards.columns).orderBy("section", F.lower(F.coalesce("label", "uri")), "uri")


def resource_view(cards: DataFrame, uri: str) -> DataFrame:
    """The cards of one resource; empty if it isn't there (``resources_view`` says so in a row)."""
    return cards.where(F.col("uri") == uri)


def resources_view(cards: DataFrame, asked: DataFrame) -> DataFrame:
    """The cards of all resources that are ``asked`` for (uri), with an error in place of a card for those that aren't there."""
    rows = asked.select("uri").distinct().join(cards.withColumn("_is_there", F.lit(True)), "uri", "left")
    missing = F.col("_is_there").isNull()
    return rows.withColumn("error", F.when(missing, F.concat(F.lit("Resource "), F.coalesce("uri", F.lit("")), F.lit(" not found")))).drop("_is_there")


def metadata_view(found: DataFrame, shown: DataFrame, stated: DataFrame, labels: DataFrame, language: str | None = None, namespaces: DataFrame | None = None) -> DataFrame:
    """rank, name, text, link, is_visualizable of the first model by IRI; empty if there is none.

    By rank: its address, its label, what its card shows (``shown``: relations without labels), what statements say about
    it (``stated``: s, p, o, o_lang; under the predicate's name, with those of the same name merged) and the declared
    prefixes. Links that look like ontologies can be shown as such.
    """
    first = F.broadcast(found.where("cls = 'Model'").agg(F.min("id").alias("id")).where("id is not null"))
    none = F.lit(None).cast("string")
    row = lambda rank, name, text, link: [F.lit(rank).alias("rank"), name.alias("name"), text.alias("text"), link.alias("link")]
    out = first.select(*row(0, F.lit("uri"), F.col("id"), F.col("id")))
    out = out.unionByName(first.join(labels, "id").select(*row(1, F.lit("label"), F.col("label"), none)))
    out = out.unionByName(shown.where("name <> 'label'").join(first, "id").select(*row(2, F.col("name"), F.col("text"), F.col("link"))))
    about = in_language(stated.withColumnRenamed("o_lang", "lang"), language).join(first, F.col("s") == F.col("id"), "left_semi")
    target = labels.join(found.where("cls <> 'Literal'").select("id"), "id", "left_semi").distinct().select(F.col("id").alias("o"), "label")
    out = out.unionByName(about.join(target, "o", "left").select(*row(3, clean_name(local_name(F.col("p"))), F.coalesce("label", "o"), F.when(F.col("label").isNotNull(), F.col("o")))))
    if namespaces is not None:
        prefix = F.when(F.col("prefix") == "", F.lit("default namespace")).otherwise(F.col("prefix"))
        out = out.unionByName(namespaces.withColumn("_one", F.lit(1)).join(first.select(F.lit(1).alias("_one")), "_one", "left_semi").select(*row(4, prefix, F.col("uri"), F.col("uri"))))
    return out.where("text <> ''").distinct().withColumn("is_visualizable", F.coalesce(likely_ontology(F.col("link")), F.lit(False)))


def ontology_metadata(triples: DataFrame) -> DataFrame:
    """attr, v of the first model (by IRI)."""
    models = match(triples, p="rdf:type").where(F.col("o").isin(iri("owl:Ontology"), iri("skos:ConceptScheme"))).select("s")
    first = models.agg(F.min("s").alias("s"))
    return triples.join(first, "s", "left_semi").where(F.col("p") != iri("rdf:type")).select(clean_name(local_name(F.col("p"))).alias("attr"), F.col("o").alias("v")).distinct()


# ------------------------------------------------------------------ restriction texts


def _short(x: Column) -> Column:
    return F.when(x.contains("/") | x.contains("#"), local_name(x)).otherwise(x)


def restriction_texts(triples: DataFrame, items: DataFrame) -> DataFrame:
    """id, text in Manchester style: ``p some C``, ``p min 1C``, ``(A and B)``, ``one of { a, b }``, ``p value v``,
    ``D restricted by >= 0``.

    Texts are built from the inside out: a round gives the text of every node all of whose parts have one.
    Parts are the rows of one table, so nesting costs rounds and not joins within rows.
    """
    prop = on_property(triples).groupBy(F.col("restriction").alias("id")).agg(F.min(F.struct("property", "is_inverse")).alias("m")).select("id", F.concat(F.when(F.col("m.is_inverse"), "inverse of ").otherwise(""), _short(F.col("m.property"))).alias("name"))
    part = lambda df, number, before, what, after: df.select("id", F.lit(number).alias("n") if isinstance(number, int) else number.alias("n"), before.alias("before"), what.alias("part"), after.alias("after"))
    none = F.lit("")
    q = quantifiers(triples).join(prop, "id", "left")
    parts = part(q, 0, F.concat(F.coalesce("name", none), F.lit(" "), "quantifier", F.lit(" ")), F.col("filler"), none)
    c = cardinalities(triples).join(prop, "id", "left")
    only_c = c.join(q.select("id"), "id", "left_anti")
    parts = parts.unionByName(part(only_c, 0, F.concat(F.coalesce("name", none), F.lit(" "), "kind", F.lit(" "), F.coalesce(F.col("n").cast("string"), none)), F.col("filler"), none))
    v = has_values(triples).join(prop, "id", "left")
    parts = parts.unionByName(part(v, 0, F.concat(F.coalesce("name", none), F.lit(" value ")), F.col("v"), none))
    listed = list_values(triples, items, "owl:intersectionOf", "owl:unionOf", "owl:oneOf").withColumnRenamed("owner", "id")
    last = listed.groupBy("id").agg(F.max("idx").alias("last"))
    word = F.when(F.col("p") == iri("owl:intersectionOf"), " and ").when(F.col("p") == iri("owl:unionOf"), " or ").otherwise(", ")
    enumerated = F.col("p") == iri("owl:oneOf")
    opening, closing = F.when(enumerated, "one of { ").otherwise("("), F.when(enumerated, " }").otherwise(")")
    members = listed.join(last, "id")
    parts = parts.unionByName(part(members, F.col("idx").cast("int"), F.when(F.col("idx") == 1, opening).otherwise(word), F.col("item"), F.when(F.col("idx") == F.col("last"), closing).otherwise("")))
    negated = truth_functions(triples, items).where("operator = 'not'")
    parts = parts.unionByName(part(negated, 0, F.lit("("), F.col("members"), F.lit(")")))
    f = facets(triples, items)
    parts = parts.unionByName(part(f, F.col("idx").cast("int"), F.when(F.col("idx") == 1, F.concat(_short(F.col("datatype")), F.lit(" restricted by "), "comparator", F.lit(" "))).otherwise(F.concat(F.lit(", "), "comparator", F.lit(" "))), F.col("v"), none))
    parts = materialize(parts.where("id like '\\_:%'"))
    total = parts.groupBy("id").agg(F.count("*").alias("total"))
    done = parts.sparkSession.createDataFrame([], "id string, text string")
    nodes = parts.select(F.col("id").alias("part")).distinct().withColumn("inner", F.lit(True))
    todo, before = total.count(), 0
    while True:
        known = done.select(F.col("id").alias("part"), "text")
        filled = parts.join(nodes, "part", "left").join(known, "part", "left").where("inner is null or text is not null")
        ready = filled.groupBy("id").agg(F.count("*").alias("k"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat("before", F.coalesce("text", _short(F.col("part"))), "after").alias("t")))), lambda x: x["t"]), "").alias("text"))
        done = materialize(ready.join(total, "id").where("k = total").select("id", "text"))
        n = done.count()
        if n in (before, todo):
            return done
        before = n


def chain_texts(chains: DataFrame) -> DataFrame:
    """owner, text: ``a o b`` for property chains (owner, idx, item)."""
    return chains.groupBy("owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "item"))), lambda x: _short(x["item"])), " o ").alias("text"))


# ------------------------------------------------------------------ hierarchies


def _inner_links(triples: DataFrame, p: str, nodes: DataFrame) -> DataFrame:
    """child, parent under ``p`` among ``nodes`` (id), without self loops."""
    edges = match(triples, p=p).where("s <> o").select(F.col("s").alias("child"), F.col("o").alias("parent")).distinct()
    return materialize(edges.join(nodes.select(F.col("id").alias("child")), "child", "left_semi").join(nodes.select(F.col("id").alias("parent")), "parent", "left_semi"))


def forest(triples: DataFrame, p: str, nodes: DataFrame, language: str = "en") -> DataFrame:
    """node, parent, label, depth, enter, leave, in_tree of the forest under ``p`` among ``nodes`` (id): a row for each
    node that a root reaches, and one for each further parent that it has.

    A node stands in the tree under its smallest parent of least depth (``in_tree``); its children follow by label. Pre-order
    numbers tell what lies below what: see ``ordering.numbered``. Rows are nodes and links, however many ways there
    are; ``hierarchy`` gives the ways themselves.
    """
    nodes = materialize(nodes.select("id").distinct())
    links = _inner_links(triples, p, nodes)
    tree = spanning_forest(nodes, links)
    named = materialize(numbered(materialize(tree.join(best_labels(triples, nodes, language).withColumnRenamed("id", "node"), "node"))))
    numbers = named.select("node", F.col("parent").alias("above"), "label", "depth", "enter", "leave")
    further = links.withColumnRenamed("child", "node").join(numbers, "node").where("not parent <=> above").join(named.select(F.col("node").alias("parent")), "parent", "left_semi")
    columns = ["node", "parent", "label", "depth", "enter", "leave"]
    return named.select(*columns, F.lit(True).alias("in_tree")).unionByName(further.select(*columns, F.lit(False).alias("in_tree")))


def hierarchy(triples: DataFrame, p: str, nodes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """node, path, depth of the forest under ``p`` among ``nodes`` (id): a row for each way from a root, or only for the
    ways to the nodes ``of`` (id), which are sought among their ancestors alone.

    Parents outside the nodes and self loops don't count; a way never visits a node twice.
    """
    inner = _inner_links(triples, p, nodes)
    if of is not None:
        wanted = of.select("id").distinct()
        up = closure(inner, "child", "parent", roots=wanted.withColumnRenamed("id", "a")).select(F.col("b").alias("id"))
        nodes = materialize(nodes.select("id").join(wanted.unionByName(up).distinct(), "id", "left_semi"))
        inner = materialize(inner.join(nodes.select(F.col("id").alias("child")), "child", "left_semi"))
    level = materialize(nodes.select("id").distinct().join(inner.select(F.col("child").alias("id")), "id", "left_anti").select(F.col("id").alias("node"), F.array("id").alias("way")))
    levels = level
    while not level.isEmpty():
        level = materialize(level.join(inner, level["node"] == inner["parent"]).where(~F.array_contains("way", F.col("child"))).select(F.col("child").alias("node"), F.concat("way", F.array("child")).alias("way")))
        levels = levels.unionByName(level)
    if of is not None:
        levels = levels.join(of.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    return levels.select("node", F.array_join(F.transform("way", _short), "/").alias("path"), (F.size("way") - 1).alias("depth"))


def likely_ontology(url: Column) -> Column:
    """Whether a url looks like an ontology: its path's extension, its registry, W3C core, or a keyword."""
    clean = F.lower(F.trim(url))
    path = F.rtrim(F.lit("/"), F.regexp_extract(clean, r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    tests = [path.endswith(x) for x in EXTENSIONS] + [clean.contains(x) for x in REGISTRIES + KEYWORDS] + [clean.contains("w3.org") & clean.contains(x) for x in W3C_CORE]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return F.coalesce(url.startswith("http") & out, F.lit(False))
