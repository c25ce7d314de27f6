"""What a service answers with: an artefact behind an address or an upload, as a view, as RDF under a file name, or an error.

Artefacts are at most ``MAX_BYTES`` long when they come in; their triples are kept as Parquet in the spool folder, which driver
and executors share, and all that is answered is a DataFrame over them.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable
from typing import NamedTuple
from urllib.parse import urlencode

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.serialize import content_format, serialized
from ..sources import fetch, parse, spool
from ..sources import validate as V
from .engine import Ontology

# Media type and file suffix of each format.
MEDIA = {"ttl": ("text/turtle", "ttl"), "xml": ("application/rdf+xml", "rdf"), "n3": ("text/n3", "n3")}
COLUMNS = ["s", "s_kind", "p", "o", "o_kind", "o_lang", "o_dt"]


class Answer(NamedTuple):
    """``frame``: cards of a view, or root and text of an export, in rows; errors have a payload instead."""

    status: int
    media: str
    filename: str | None = None
    frame: DataFrame | None = None
    payload: dict | None = None


def file_name(resource: str | None, url: str | None, suffix: str) -> str:
    """The last part of the resource's IRI, else of the url; ``resource`` or ``graph`` where there is none."""
    if resource:
        return (resource.rstrip("/").rsplit("#", 1)[-1].rsplit("/", 1)[-1] or "resource") + f".{suffix}"
    return ((url or "").rstrip("/").rsplit("/", 1)[-1] or "graph") + f".{suffix}"


def url_token(url: str, read_as: str, imported: bool = False, closure: bool = False) -> str:
    """The same name as ``functions.text.url_token`` gives."""
    return "url_" + hashlib.sha256(f"{url}|{read_as}|{imported}|{closure}".encode()).hexdigest()[:32]


def navigation(read_as: str, url: str | None = None, upload: str | None = None, language: str | None = None) -> str:
    """The query string that links of a view carry; an upload goes before a url."""
    return urlencode({"read_as": read_as, "lang": language or "", **({"upload_id": upload} if upload else {"url": url or ""})})


def _frame(spark: SparkSession, doc: str, triples: list) -> DataFrame:
    return parse.readable(spark.createDataFrame([(doc, *t) for t in parse.own_bnodes(doc, triples)], parse.SCHEMA)).select(*COLUMNS)


def accept_upload(spark: SparkSession, root: str, name: str, data: bytes) -> str:
    """Checks and parses an upload and keeps its triples; the token under which they are.

    Raises ArtefactValidationError for a name or content that isn't allowed, and ArtefactLoadError if nothing parses.
    """
    if not name or not name.lower().endswith(tuple(V.SUFFIXES)):
        raise V.ArtefactValidationError("refused: extension", code="extension" if name else "missing", name=name)
    V.check_size(len(data))
    token = uuid.uuid4().hex
    triples = parse.parse_text(V.check_content(data), name)
    spool.cached(spark, root, token, lambda: _frame(spark, token, triples))
    return token


def resolve(spark: SparkSession, root: str, read_as: str, url: str | None = None, upload: str | None = None, imported: bool = False, closure: bool = False, catalogue: DataFrame | None = None, use_cache: bool = True, get: Callable[[str], list] | None = None, check: Callable[[str], None] = V.check_url) -> Ontology:
    """The artefact of an upload, else of a url. What a url gave is kept; without ``use_cache`` it is fetched anew.

    ``get`` gives the triples of a url. Raises ArtefactValidationError for neither, or for an upload that is gone.
    """
    if upload:
        try:
            triples = spark.read.parquet(spool.upload_path(root, upload))
        except AnalysisException:
            raise V.ArtefactValidationError("Upload expired, please upload it again", upload=upload) from None
    elif url:
        check(url)
        token = url_token(url, read_as, imported, closure)
        if not use_cache:
            spool.forget(spark, root, [token])
        triples = spool.cached(spark, root, token, lambda: _frame(spark, url, (get or fetch.fetch)(url)))
    else:
        raise V.ArtefactValidationError("Missing 'url' or 'upload'")
    return Ontology.over(triples, read_as, imported, closure, catalogue)


def extract(own: Ontology, resource: str | None = None, language: str | None = None, fmt: str | None = None, accept: str | None = None, url: str | None = None) -> Answer:
    """RDF if a known format, or an Accept header that is one, asks for it; else a view. A known format wins.

    A whole graph is written by subject, a row each, so that no task holds all of it.
    """
    wanted = content_format(fmt if fmt in (*MEDIA, "rdf") else None, accept)
    if wanted in MEDIA:
        media, suffix = MEDIA[wanted]
        text = own.export(resource, wanted) if resource else serialized(own.triples.withColumn("root", F.col("s")), wanted)
        return Answer(200, media, file_name(resource, url, suffix), text)
    if resource:
        asked = own.triples.sparkSession.createDataFrame([(resource,)], "uri string")
        return Answer(200, "text/html", frame=own.resources(asked, language or "en"))
    return Answer(200, "text/html", frame=own.concept_cards(language) if own.dialect == "skos" else own.view(language))


def answered(work: Callable[[], Answer], debug: bool = False) -> Answer:
    """What ``work`` answers; 400 with the payload of an artefact's error, 500 for any other, which tells no more than its type."""
    try:
        return work()
    except V.ArtefactError as e:
        return Answer(400, "application/json", payload=e.payload(debug))
    except Exception as e:  # the last line of a service: whatever fails is an answer
        return Answer(500, "application/json", payload=V.ArtefactError("Unexpected error", cause=type(e).__name__).payload() | ({"traceback": repr(e)} if debug else {}))


def prune(spark: SparkSession, root: str, now: float | None = None, ttl: int = spool.TTL, budget: int = spool.BUDGET) -> list[str]:
    """Forgets what is too old or beyond the budget; the tokens that went."""
    tokens = spool.tokens(spark, root)
    stay = spool.kept(tokens, int(time.time() if now is None else now), ttl, budget).select("name")
    gone = [r[0] for r in tokens.join(stay, "name", "left_anti").select("name").toLocalIterator()]
    spool.forget(spark, root, gone)
    return gone
