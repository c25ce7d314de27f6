"""Names, anchors and namespaces as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def namespace_of(p: Column) -> Column:
    """Up to and with the last ``#``, else up to and with the last ``/``."""
    return F.when(F.instr(p, "#") > 0, F.regexp_extract(p, "^(.*#)", 1)).otherwise(F.regexp_extract(p, "^(.*/)", 1))


def in_namespaces(p: Column, namespaces: list[str]) -> Column:
    """Whether ``namespace_of`` is one of these, told without a regular expression, as every triple is asked."""
    out = F.lit(False)
    for ns in namespaces:
        rest = F.substring(p, len(ns) + 1, 1 << 30)
        out = out | (p.startswith(ns) & ((F.instr(rest, "#") == 0) if ns.endswith("#") else (F.instr(p, "#") == 0) & (F.instr(rest, "/") == 0)))
    return out


def local_name(x: Column) -> Column:
    return F.regexp_extract(x, "([^/#]*)$", 1)


def clean_name(x: Column) -> Column:
    """``get_has_subClassOf`` -> ``sub Class Of``: accessor prefixes go, camel case and underscores become spaces."""
    bare = F.regexp_replace(x, "^(get_has_|get_|has_)", "")
    split = F.regexp_replace(bare, "([a-z0-9])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(F.translate(split, "_", " "), " +", " "))


def anchor(uri: Column, cls: Column) -> Column:
    return F.concat(F.lit("id_"), F.md5(uri), F.lit("_"), cls)


def slug(uri: Column) -> Column:
    """A file name for an IRI: no scheme, ``/`` and ``#`` as ``_``."""
    return F.translate(F.regexp_replace(uri, "^https?://", ""), "/#", "__")


def url_token(url: Column, read_as: str, imported: bool, closure: bool) -> Column:
    """The name under which a fetched artefact is kept."""
    return F.concat(F.lit("url_"), F.substring(F.sha2(F.concat_ws("|", url, F.lit(read_as), F.lit(str(imported)), F.lit(str(closure))), 256), 1, 32))


def query_string(**parts: Column) -> Column:
    """``a=..&b=..`` of the parts that aren't null."""
    return F.concat_ws("&", *[F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), F.url_encode(v))) for k, v in parts.items()])
