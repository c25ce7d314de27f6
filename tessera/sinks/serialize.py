"""Triples as N-Triples, Turtle, N3 and RDF/XML, one file's text for each document or resource."""

from __future__ import annotations

from collections.abc import Iterable
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..vocab import PREFIXES

RDF = PREFIXES["rdf"]


def nt_lines(triples: DataFrame) -> DataFrame:
    """One column ``value`` of N-Triples lines, by expressions alone."""
    node = lambda x, kind: F.when(kind == "bnode", x).otherwise(F.concat(F.lit("<"), x, F.lit(">")))
    text = F.col("o")
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    mark = F.when(F.col("o_lang") != "", F.concat(F.lit("@"), "o_lang")).when(F.col("o_dt") != "", F.concat(F.lit("^^<"), "o_dt", F.lit(">"))).otherwise("")
    o = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), text, F.lit('"'), mark)).otherwise(node(F.col("o"), F.col("o_kind")))
    return triples.select(F.concat_ws(" ", node(F.col("s"), F.col("s_kind")), F.concat(F.lit("<"), "p", F.lit(">")), o, F.lit(".")).alias("value"))


def write_nt(triples: DataFrame, path: str) -> None:
    nt_lines(triples).write.mode("overwrite").text(path)


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'


def turtle(rows: Iterable[tuple]) -> str:
    """Turtle (and N3) of (s, s_kind, p, o, o_kind, o_lang, o_dt) rows, grouped by subject and predicate."""

    def name(x: str, kind: str = "iri") -> str:
        if kind == "bnode":
            return x
        for prefix, ns in PREFIXES.items():
            local = x[len(ns) :]
            if x.startswith(ns) and local.replace("_", "").isalnum() and local.isascii():
                return f"{prefix}:{local}"
        return f"<{x}>"

    by: dict[tuple, dict[str, list[str]]] = {}
    for s, s_kind, p, o, o_kind, lang, dt in sorted(set(rows)):
        value = _quoted(o) + (f"@{lang}" if lang else f"^^{name(dt)}" if dt else "") if o_kind == "literal" else name(o, o_kind)
        by.setdefault((s, s_kind), {}).setdefault("a" if p == RDF + "type" else name(p), []).append(value)
    head = "".join(f"@prefix {p}: <{ns}> .\n" for p, ns in PREFIXES.items())
    return head + "".join(f"\n{name(*s)} " + " ;\n    ".join(f"{p} {', '.join(os)}" for p, os in pairs.items()) + " .\n" for s, pairs in by.items())


def rdf_xml(rows: Iterable[tuple]) -> str:
    """RDF/XML; predicates that have no XML name raise ValueError."""
    import re

    by: dict[tuple, list[tuple]] = {}
    spaces: dict[str, str] = {RDF: "rdf"}
    for s, s_kind, p, *rest in sorted(set(rows)):
        m = re.match(r"^(.*?)([A-Za-z_][\w.\-]*)$", p)
        if not m:
            raise ValueError(f"no XML name in {p}")
        known = {ns: prefix for prefix, ns in PREFIXES.items()}
        spaces.setdefault(m[1], known.get(m[1], f"ns{len(spaces)}"))
        by.setdefault((s, s_kind), []).append((f"{spaces[m[1]]}:{m[2]}", *rest))
    out = ['<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF' + "".join(f"\n  xmlns:{p}={quoteattr(ns)}" for ns, p in spaces.items()) + ">\n"]
    for (s, kind), pairs in by.items():
        out.append(f"  <rdf:Description {'rdf:nodeID=' + quoteattr(s[2:]) if kind == 'bnode' else 'rdf:about=' + quoteattr(s)}>\n")
        for p, o, o_kind, lang, dt in pairs:
            if o_kind == "literal":
                mark = f" xml:lang={quoteattr(lang)}" if lang else f" rdf:datatype={quoteattr(dt)}" if dt else ""
                out.append(f"    <{p}{mark}>{escape(o)}</{p}>\n")
            else:
                out.append(f"    <{p} {'rdf:nodeID=' + quoteattr(o[2:]) if o_kind == 'bnode' else 'rdf:resource=' + quoteattr(o)}/>\n")
        out.append("  </rdf:Description>\n")
    return "".join(out) + "</rdf:RDF>\n"


WRITERS = {"ttl": turtle, "n3": turtle, "xml": rdf_xml, "rdf": rdf_xml}


def serialized(triples: DataFrame, fmt: str, by: str = "root") -> DataFrame:
    """``by`` and the text of its triples; what can't be written becomes a comment with the reason."""
    columns = ["s", "s_kind", "p", "o", "o_kind", "o_lang", "o_dt"]

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        try:
            body = WRITERS[fmt](frame[columns].itertuples(index=False, name=None))
        except ValueError as e:
            body = f"# {e}\n"
        return pd.DataFrame({by: [frame[by].iloc[0]], "text": [body]})

    return triples.groupBy(by).applyInPandas(write, f"{by} string, text string")


def content_format(wanted: str | None, accept: str | None) -> str:
    """ttl, xml, n3 or html: an explicit format wins over the Accept header, which must match exactly."""
    # Media types that are answered in RDF.
    media = {"text/turtle": "ttl", "application/rdf+xml": "xml", "text/n3": "n3"}
    if wanted:
        return {"rdf": "xml"}.get(wanted, wanted)
    return media.get(accept or "", "html")


