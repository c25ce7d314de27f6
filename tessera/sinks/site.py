"""A static documentation site: an index and a page for each entity, written from the executors' rows."""

from __future__ import annotations

import html
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug
from ..plans.views import contents

STYLE = "body{font:16px sans-serif;max-width:60em;margin:2em auto}table{border-collapse:collapse}td{padding:.2em .8em;border-bottom:1px solid #ddd}.deprecated{text-decoration:line-through}"


def _link(prefix: str):
    return F.concat(F.lit(prefix), "section", F.lit("/"), slug(F.col("uri")), F.lit(".html"))


def _esc(x):
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(plain), F.lit(entity))
    return x


def pages(cards: DataFrame, values: DataFrame) -> DataFrame:
    """path, html of every card (section, uri, label, ...) with its values (uri, name, text).

    Rows of a page are gathered by entity; a page is as long as its entity has values.
    """
    cells = values.select("uri", F.concat(F.lit("<tr><td>"), _esc(F.col("name")), F.lit("</td><td>"), _esc(F.col("text")), F.lit("</td></tr>")).alias("row"))
    tables = cells.groupBy("uri").agg(F.array_join(F.array_sort(F.collect_set("row")), "").alias("rows"))
    title = _esc(F.col("label"))
    body = F.concat(F.lit(f"<!doctype html><meta charset=utf-8><style>{STYLE}</style><title>"), title, F.lit("</title><p><a href='../../index.html'>index</a></p><h1 class='"), F.when(F.col("is_deprecated"), "deprecated").otherwise(""), F.lit("'>"), title, F.lit("</h1><p>"), _esc(F.col("uri")), F.lit("</p><table>"), F.coalesce("rows", F.lit("")), F.lit("</table>"))
    return cards.join(tables, "uri", "left").select(_link("resources/").alias("path"), body.alias("html"))


def write_site(cards: DataFrame, values: DataFrame, out: str, dialect: str = "owl", title: str = "Ontology") -> int:
    """Writes the site of one artefact to a local folder; returns the number of entity pages.

    Pages come to the driver one partition at a time, as they go to a folder of the machine that asked for
    them. A corpus of artefacts is better written as the table that ``pages`` returns.
    """
    root = Path(out)
    root.mkdir(parents=True, exist_ok=True)
    n = 0
    for row in pages(cards, values).toLocalIterator():
        file = root / row["path"]
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(row["html"], encoding="utf-8")
        n += 1
    index = [f"<!doctype html><meta charset=utf-8><style>{STYLE}</style><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    entries = cards.select("section", "label", _link("resources/").alias("href")).orderBy("section", F.lower("label"))
    by: dict[str, list[str]] = {}
    for r in entries.toLocalIterator():
        by.setdefault(r["section"], []).append(f"<li><a href='{html.escape(r['href'], True)}'>{html.escape(r['label'])}</a></li>")
    for section in contents(dialect):
        if section in by:
            index.append(f"<h2>{section} ({len(by[section])})</h2><ul>{''.join(by[section])}</ul>")
    (root / "index.html").write_text("".join(index), encoding="utf-8")
    return n
