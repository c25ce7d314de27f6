"""Parsers of RDF serialisations: N-Triples line by line in Spark, whole files of the other formats in tasks.

A parser is a small function from text to triples; it runs on the file that a task was given. Files are the
unit of parallelism: an artefact is at most ``MAX_BYTES`` long, and a corpus has many of them.
"""

from __future__ import annotations

import hashlib
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..vocab import PREFIXES, iri
from .validate import ArtefactLoadError, check_content

SCHEMA = "doc string, s string, s_kind string, p string, o string, o_kind string, o_lang string, o_dt string"
RDF, XSD, XML = PREFIXES["rdf"], PREFIXES["xsd"], "{http://www.w3.org/XML/1998/namespace}"
#: The order in which formats are tried.
FILE_ORDER, URL_ORDER = ["xml", "turtle", "n3", "nt", "json-ld"], ["xml", "turtle", "json-ld", "nt", "n3"]

Node = tuple[str, str]  # kind, value
Triple = tuple[str, str, str, str, str, str, str]  # s, s_kind, p, o, o_kind, o_lang, o_dt


def _triple(s: Node, p: str, o: Node, lang: str = "", dt: str = "") -> Triple:
    return (s[1], s[0], p, o[1], o[0], lang, dt)


def _unescape(text: str) -> str:
    if "\\" not in text:
        return text
    plain = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else plain.get(m[1], m[1]), text, flags=re.S)


class Turtle:
    """Recursive descent over Turtle, and what N3 adds for plain data (``=``, ``=>`` aren't data)."""

    TOKEN = re.compile(
        r"""\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\x00-\x20]*(?:\\[uU][0-9A-Fa-f]+[^<>"{}|^`\\\x00-\x20]*)*>)
        |(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')|(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
        |(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<dt>\^\^)|(?P<bnode>_:[\w\-]+(?:\.+[\w\-]+)*)
        |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.\d+[eE][+-]?\d+|\d+[eE][+-]?\d+|\d*\.\d+|\d+))
        |(?P<name>(?:[^\W\d_][\w\-.]*)?:(?:[\w:%\-]|\\.|\.(?=[\w:%\-\\.]))*|(?:[^\W\d_][\w\-]*))|(?P<punct>[.;,\[\]()=])""",
        re.X | re.S,
    )

    def __init__(self, text: str, base: str = ""):
        self.tokens, at = [], 0
        while at < len(text):
            m = self.TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unexpected {text[at : at + 20]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at, self.base, self.prefixes, self.out, self.blanks = 0, base, {}, [], 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *expected: str) -> tuple[str, str]:
        token = self.peek()
        if expected and token[1] not in expected and token[0] not in expected:
            raise ValueError(f"expected {expected}, found {token[1]!r}")
        self.at += 1
        return token

    def blank(self) -> Node:
        self.blanks += 1
        return ("bnode", f"_:g{self.blanks}")

    def resolve(self, token: tuple[str, str]) -> str:
        if token[0] == "iri":
            return urljoin(self.base, _unescape(token[1][1:-1])) if self.base else _unescape(token[1][1:-1])
        prefix, _, name = token[1].partition(":")
        if prefix not in self.prefixes:
            raise ValueError(f"no prefix {prefix!r}")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", name)

    def parse(self) -> list[Triple]:
        while self.peek()[0] != "end":
            kind, value = self.peek()
            if value.lower() in ("@prefix", "prefix", "@base", "base") and kind in ("at", "name"):
                self.take()
                if "prefix" in value.lower():
                    name = self.take("name")[1]
                    self.prefixes[name[:-1]] = self.resolve(self.take("iri"))
                else:
                    self.base = self.resolve(self.take("iri"))
                if value[0] == "@":
                    self.take(".")
                continue
            bracket = value == "["
            subject = self.node()
            if not (bracket and self.peek()[1] == "."):
                self.pairs(subject)
            self.take(".")
        return self.out

    def pairs(self, subject: Node) -> None:
        while True:
            kind, value = self.take("iri", "name", "=")
            p = RDF + "type" if (kind, value) == ("name", "a") else iri("owl:sameAs") if value == "=" else self.resolve((kind, value))
            while True:
                self.object(subject, p)
                if self.peek()[1] != ",":
                    break
                self.take()
            while self.peek()[1] == ";":
                self.take()
                again = self.peek()[1] not in (".", "]", ";", "")
            if self.tokens[self.at - 1][1] != ";" or not again:
                return

    def object(self, subject: Node, p: str) -> None:
        kind, value = self.peek()
        if kind in ("text", "long"):
            self.take()
            text, lang, dt = _unescape(value[3:-3] if kind == "long" else value[1:-1]), "", ""
            if self.peek()[0] == "at":
                lang = self.take()[1][1:]
            elif self.peek()[0] == "dt":
                self.take()
                dt = self.resolve(self.take("iri", "name"))
            self.out.append(_triple(subject, p, ("literal", text), lang, dt))
        elif kind == "number":
            self.take()
            dt = "double" if "e" in value.lower() else "decimal" if "." in value else "integer"
            self.out.append(_triple(subject, p, ("literal", value), "", XSD + dt))
        elif kind == "name" and value in ("true", "false"):
            self.take()
            self.out.append(_triple(subject, p, ("literal", value), "", XSD + "boolean"))
        else:
            self.out.append(_triple(subject, p, self.node()))

    def node(self) -> Node:
        kind, value = self.take()
        if kind in ("iri", "name") and value not in ("a", "true", "false"):
            return ("iri", self.resolve((kind, value)))
        if kind == "bnode":
            return ("bnode", value)
        if value == "[":
            own = self.blank()
            if self.peek()[1] != "]":
                self.pairs(own)
            self.take("]")
            return own
        if value == "(":
            head, last = ("iri", RDF + "nil"), None
            while self.peek()[1] != ")":
                own = self.blank()
                if last:
                    self.out.append(_triple(last, RDF + "rest", own))
                else:
                    head = own
                self.object(own, RDF + "first")
                last = own
            self.take(")")
            if last:
                self.out.append(_triple(last, RDF + "rest", ("iri", RDF + "nil")))
            return head
        raise ValueError(f"unexpected {value!r}")


NT_LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:(<[^>]*>|_:[^\s.]+)|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)\s*\.\s*(?:#.*)?$'


def parse_nt(text: str, base: str = "") -> list[Triple]:
    out = []
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        m = re.match(NT_LINE, line)
        if not m:
            raise ValueError(f"no N-Triples line: {line[:60]!r}")
        node = lambda x: ("bnode", x) if x.startswith("_:") else ("iri", _unescape(x[1:-1]))
        out.append(_triple(node(m[1]), _unescape(m[2]), node(m[3])) if m[3] else _triple(node(m[1]), _unescape(m[2]), ("literal", _unescape(m[4])), m[5] or "", m[6] or ""))
    return out


class RdfXml:
    def __init__(self, text: str, base: str = ""):
        self.root, self.base, self.out, self.blanks = ET.fromstring(text), base, [], 0

    def blank(self, name: str | None = None) -> Node:
        self.blanks += name is None
        return ("bnode", f"_:n{name}" if name else f"_:g{self.blanks}")

    def parse(self) -> list[Triple]:
        base = self.root.get(XML + "base", self.base)
        if self.root.tag == f"{{{RDF}}}RDF":
            for child in self.root:
                self.described(child, base, self.root.get(XML + "lang", ""))
        elif self.root.tag.startswith("{"):
            self.described(self.root, base, "")
        else:
            raise ValueError("no RDF/XML")
        return self.out

    def described(self, e: ET.Element, base: str, lang: str) -> Node:
        base, lang = e.get(XML + "base", base), e.get(XML + "lang", lang)
        get = lambda name: e.get(f"{{{RDF}}}{name}")
        own = ("iri", urljoin(base, get("about"))) if get("about") is not None else ("iri", urljoin(base, "#" + get("ID"))) if get("ID") else self.blank(get("nodeID"))
        tag = e.tag[1:].replace("}", "")
        if tag != RDF + "Description":
            self.out.append(_triple(own, RDF + "type", ("iri", tag)))
        self.attributes(own, e, lang)
        number = 0
        for child in e:
            p = child.tag[1:].replace("}", "")
            if p == RDF + "li":
                number += 1
                p = f"{RDF}_{number}"
            self.property(own, p, child, base, lang)
        return own

    def attributes(self, own: Node, e: ET.Element, lang: str) -> None:
        for name, value in e.attrib.items():
            if name.startswith("{") and not name.startswith(XML):
                p = name[1:].replace("}", "")
                if p == RDF + "type":
                    self.out.append(_triple(own, p, ("iri", value)))
                elif not p.startswith(RDF) or re.fullmatch(r"_\d+", p[len(RDF) :]):
                    self.out.append(_triple(own, p, ("literal", value), lang))

    def property(self, own: Node, p: str, e: ET.Element, base: str, lang: str) -> None:
        base, lang = e.get(XML + "base", base), e.get(XML + "lang", lang)
        get = lambda name: e.get(f"{{{RDF}}}{name}")
        start = len(self.out)
        kind = get("parseType")
        if kind == "Resource":
            o = self.blank()
            self.out.append(_triple(own, p, o))
            for child in e:
                self.property(o, child.tag[1:].replace("}", ""), child, base, lang)
        elif kind == "Collection":
            nodes = [self.described(child, base, lang) for child in e]
            cells = [self.blank() for _ in nodes]
            self.out.append(_triple(own, p, cells[0] if cells else ("iri", RDF + "nil")))
            for k, (cell, node) in enumerate(zip(cells, nodes)):
                self.out.append(_triple(cell, RDF + "first", node))
                self.out.append(_triple(cell, RDF + "rest", cells[k + 1] if k + 1 < len(cells) else ("iri", RDF + "nil")))
        elif kind is not None:
            inner = (e.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in e)
            self.out.append(_triple(own, p, ("literal", inner), "", RDF + "XMLLiteral"))
        elif len(e):
            self.out.append(_triple(own, p, self.described(e[0], base, lang)))
        elif get("resource") is not None or get("nodeID") is not None:
            o = ("iri", urljoin(base, get("resource"))) if get("resource") is not None else self.blank(get("nodeID"))
            self.out.append(_triple(own, p, o))
            self.attributes(o, e, lang)
        elif any(n.startswith("{") and not n.startswith(XML) and not n.startswith(f"{{{RDF}}}") for n in e.attrib):
            o = self.blank()
            self.out.append(_triple(own, p, o))
            self.attributes(o, e, lang)
        else:
            dt = get("datatype") or ""
            self.out.append(_triple(own, p, ("literal", e.text or ""), "" if dt else lang, dt))
        if get("ID"):
            stmt = ("iri", urljoin(base, "#" + get("ID")))
            made = next(t for t in self.out[start:] if t[0] == own[1] and t[2] == p)
            self.out += [_triple(stmt, RDF + "type", ("iri", RDF + "Statement")), _triple(stmt, RDF + "subject", own), _triple(stmt, RDF + "predicate", ("iri", p)), (stmt[1], "iri", RDF + "object", *made[3:])]


class JsonLd:
    """Expanded and simply compacted JSON-LD: inline contexts with terms, prefixes, @vocab, @language, @type, @container @list."""

    def __init__(self, text: str, base: str = ""):
        self.data, self.base, self.out, self.blanks = json.loads(text), base, [], 0

    def parse(self) -> list[Triple]:
        if not isinstance(self.data, (dict, list)):
            raise ValueError("no JSON-LD")
        for item in self.data if isinstance(self.data, list) else [self.data]:
            self.node(item, {})
        return self.out

    def context(self, own, context: dict) -> dict:
        for part in own if isinstance(own, list) else [own]:
            if isinstance(part, dict):
                context = context | part
        return context

    def name(self, term: str, context: dict, vocab: bool = True) -> str:
        found = context.get(term)
        if vocab and isinstance(found, dict):
            found = found.get("@id")
        if vocab and isinstance(found, str) and found != term:
            return self.name(found, context)
        prefix, colon, rest = term.partition(":")
        if colon and not rest.startswith("//") and prefix in context:
            start = context[prefix]
            return self.name(start["@id"] if isinstance(start, dict) else start, context) + rest
        if colon:
            return term
        return context["@vocab"] + term if vocab and "@vocab" in context else urljoin(context.get("@base") or self.base, term)

    def blank(self) -> Node:
        self.blanks += 1
        return ("bnode", f"_:g{self.blanks}")

    def resource(self, value: str, context: dict) -> Node:
        return ("bnode", value) if value.startswith("_:") else ("iri", self.name(value, context, False))

    def node(self, item: dict, context: dict) -> Node:
        if "@context" in item:
            context = self.context(item["@context"], context)
        alias = {k: v for k, v in context.items() if isinstance(v, str) and v.startswith("@")}
        item = {alias.get(k, k): v for k, v in item.items()}
        own = self.resource(item["@id"], context) if "@id" in item else self.blank()
        for inner in self.listed(item.get("@graph", [])):
            self.node(inner, context)
        for kind in self.listed(item.get("@type", [])):
            self.out.append(_triple(own, RDF + "type", ("iri", self.name(kind, context))))
        for key, values in item.items():
            if key.startswith("@"):
                continue
            term = context.get(key) if isinstance(context.get(key), dict) else {}
            p = self.name(key, context)
            if ":" not in p:
                continue
            if term.get("@container") == "@list" and not (isinstance(values, dict) and "@list" in values):
                values = [{"@list": self.listed(values)}]
            if term.get("@container") == "@language" and isinstance(values, dict):
                values = [{"@value": v, "@language": k} for k, vs in values.items() for v in self.listed(vs)]
            for value in self.listed(values):
                self.value(own, p, value, term, context)
        return own

    @staticmethod
    def listed(x) -> list:
        return x if isinstance(x, list) else [x]

    def value(self, own: Node, p: str, value, term: dict, context: dict) -> None:
        if value is None:
            return
        if isinstance(value, dict) and "@list" in value:
            items = self.listed(value["@list"])
            cells = [self.blank() for _ in items]
            self.out.append(_triple(own, p, cells[0] if cells else ("iri", RDF + "nil")))
            for k, (cell, item) in enumerate(zip(cells, items)):
                self.value(cell, RDF + "first", item, term, context)
                self.out.append(_triple(cell, RDF + "rest", cells[k + 1] if k + 1 < len(cells) else ("iri", RDF + "nil")))
        elif isinstance(value, dict) and "@value" in value:
            self.literal(own, p, value["@value"], value.get("@language", ""), self.name(value["@type"], context) if "@type" in value else "")
        elif isinstance(value, dict):
            self.out.append(_triple(own, p, self.node(value, context)))
        elif isinstance(value, str) and term.get("@type") in ("@id", "@vocab"):
            self.out.append(_triple(own, p, self.resource(value, context) if term["@type"] == "@id" else ("iri", self.name(value, context))))
        else:
            typed = self.name(term["@type"], context) if term.get("@type") and term["@type"] != "@id" else ""
            self.literal(own, p, value, term.get("@language", context.get("@language") or "") if isinstance(value, str) and not typed else "", typed)

    def literal(self, own: Node, p: str, value, lang: str, dt: str) -> None:
        if isinstance(value, bool):
            value, dt = str(value).lower(), dt or XSD + "boolean"
        elif isinstance(value, (int, float)):
            dt, value = dt or XSD + ("integer" if isinstance(value, int) else "double"), str(value)
        self.out.append(_triple(own, p, ("literal", value), lang, dt))


PARSERS = {"xml": lambda t, b: RdfXml(t, b).parse(), "turtle": lambda t, b: Turtle(t, b).parse(), "n3": lambda t, b: Turtle(t, b).parse(), "nt": parse_nt, "json-ld": lambda t, b: JsonLd(t, b).parse()}


def guess_format(content_type: str | None) -> str | None:
    """The format of a Content-Type header, if it names one."""
    kind = (content_type or "").lower()
    for mark, name in (("turtle", "turtle"), ("xml", "xml"), ("json", "json-ld"), ("n-triples", "nt")):
        if mark in kind:
            return name
    return None


def parse_text(text: str, base: str = "", order: list[str] = FILE_ORDER, first: str | None = None) -> list[Triple]:
    """Triples of the first format that parses to any; raises ArtefactLoadError if none does."""
    for name in ([first] if first else []) + [f for f in order if f != first]:
        try:
            found = PARSERS[name](text, base)
        except (ValueError, KeyError, TypeError, AttributeError, IndexError, ET.ParseError, StopIteration):
            continue
        if found:
            return list(dict.fromkeys(found))
    raise ArtefactLoadError("Could not parse RDF with any known format", tried=order)


def own_bnodes(doc: str, triples: list[Triple]) -> list[Triple]:
    """Blank nodes renamed by document, so that those of two files stay apart."""
    new = lambda x: "_:b" + hashlib.sha256(f"{doc}|{x}".encode()).hexdigest()[:24]
    return [(new(t[0]) if t[1] == "bnode" else t[0], t[1], t[2], new(t[3]) if t[4] == "bnode" else t[3], *t[4:]) for t in triples]


def read_rdf(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Triples of all files under ``path``: doc (the file), s, s_kind, p, o, o_kind, o_lang, o_dt.

    Each file is checked (text, safe XML) and parsed as ``fmt``, or as the first format that fits. A file
    that can't be read gives a row with p = ``error`` and the reason as o, in place of ending the job;
    ``readable`` leaves those out and ``unreadable`` lists them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, content in zip(batch["path"], batch["content"]):
                try:
                    text = check_content(bytes(content))
                    found = own_bnodes(doc, list(dict.fromkeys(PARSERS[fmt](text, doc))) if fmt else parse_text(text, doc))
                except Exception as e:  # noqa: BLE001  whatever a parser says of a bad file
                    found = [("", "", "error", str(e), "literal", "", "")]
                yield pd.DataFrame([(doc, *t) for t in found], columns=["doc", "s", "s_kind", "p", "o", "o_kind", "o_lang", "o_dt"])

    return files.mapInPandas(parse, SCHEMA)


def readable(triples: DataFrame) -> DataFrame:
    return triples.where("p <> 'error'")


def unreadable(triples: DataFrame) -> DataFrame:
    return triples.where("p = 'error'").select("doc", F.col("o").alias("reason"))


def nt_columns(lines: DataFrame, value: str = "value") -> DataFrame:
    """Triples of N-Triples lines by expressions alone: splittable files of any size, and streams."""
    part = lambda k: F.regexp_extract(value, NT_LINE, k)
    strip = lambda x: F.when(x.startswith("_:"), x).otherwise(F.regexp_replace(x, "^<|>$", ""))
    escapes = (("\\\\\\\\", "\x00"), ("\\\\n", "\n"), ("\\\\t", "\t"), ("\\\\r", "\r"), ('\\\\"', '"'), ("\x00", "\\\\"))
    text = part(4)
    for found, plain in escapes:
        text = F.regexp_replace(text, found, plain)
    node = part(3)
    kind = lambda x: F.when(x.startswith("_:"), "bnode").otherwise("iri")
    return lines.where(F.col(value).rlike(NT_LINE)).select(strip(part(1)).alias("s"), kind(part(1)).alias("s_kind"), part(2).alias("p"), F.when(node != "", strip(node)).otherwise(text).alias("o"), F.when(node == "", "literal").otherwise(kind(node)).alias("o_kind"), part(5).alias("o_lang"), part(6).alias("o_dt"))


def read_nt(spark: SparkSession, path: str) -> DataFrame:
    return nt_columns(spark.read.text(path)).dropDuplicates()
