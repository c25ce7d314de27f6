"""Allow and block lists for urls: a broadcast trie over reversed host labels, then path segments."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import free_name

#: Most bytes of rule text that are broadcast as one trie; longer lists are matched in blocks of this size.
MAX_TRIE_BYTES = 64 << 20

RESULT = "rule string, verdict string, rank long"


class Trie:
    """Labels from the right, then whole path segments, then the start of one segment.

    A rule ``example.org`` + ``/en/1`` is stored under org, example, then the segment ``en`` and the
    partial segment ``1``. Its rank is the number of characters of host and path: the longest match
    wins, and between equally long ones the later rule of the list.
    """

    def __init__(self, rules: list[tuple[str, str, str]], first: int = 0):
        self.hosts: dict = {}
        for order, (verdict, host, path) in enumerate(rules, first):
            node = self.hosts
            for label in reversed(host.lower().split(".")):
                node = node.setdefault(label, {})
            *whole, part = path.split("/")
            paths = node.setdefault(("paths",), {})
            for segment in whole:
                paths = paths.setdefault(segment, {})
            rank = (len(host) + len(path)) * (1 << 32) + order
            entry = (rank, host + path, verdict)
            parts = paths.setdefault(("parts",), {})
            parts[part] = max(parts.get(part, entry), entry)

    def match(self, host: str, path: str) -> tuple[int, str, str] | None:
        best, node = None, self.hosts
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if ("paths",) in node:
                best = max(filter(None, (best, self._match_path(node[("paths",)], path))), default=None)
        return best

    @staticmethod
    def _match_path(node: dict, path: str) -> tuple[int, str, str] | None:
        best = None
        for segment in path.split("/"):
            parts = node.get(("parts",), {})
            for end in range(len(segment), -1, -1) if parts else ():
                found = parts.get(segment[:end])
                if found:
                    best = max(best or found, found)
                    break
            node = node.get(segment)
            if node is None:
                break
        return best


def url_host(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url):
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _blocks(rules: list[tuple[str, str, str]]) -> Iterator[tuple[int, list[tuple[str, str, str]]]]:
    """Rules in blocks of bounded size, each with the number of its first rule."""
    first, size = 0, 0
    for number, rule in enumerate(rules):
        size += sum(map(len, rule))
        if number > first and size > MAX_TRIE_BYTES:
            yield first, rules[first:number]
            first, size = number, sum(map(len, rule))
    yield first, rules[first:]


def _look_up(trie):
    @F.pandas_udf(RESULT)
    def look_up(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        hits = [trie.value.match(h, p) or (None, None, None) for h, p in zip(hosts, paths)]
        frame = pd.DataFrame(hits, columns=["rank", "rule", "verdict"], dtype=object)
        frame["rank"] = frame["rank"].astype("Int64")
        return frame[["rule", "verdict", "rank"]]

    return look_up


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to ``pages`` (columns of those names are replaced).

    ``rules``: (allow or block, host, path). A rule fits its host and all subdomains when the url's path
    starts with the rule's path; the longest rule wins. A null url, and one without ``://``, has empty
    host and path and so no rule; ports and user names stay part of the host. Urls without a rule get
    ``default``. Every row gives one row; an empty table gives none.
    """
    spark: SparkSession = pages.sparkSession
    base = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    found = []
    for first, block in _blocks(rules):
        trie = spark.sparkContext.broadcast(Trie(block, first))

        found.append(_look_up(trie)("host", "path"))
    hit = free_name(base, "_hit")
    if len(found) == 1:
        base = base.withColumn(hit, found[0])
    else:
        best = F.array_max(F.array(*[F.struct(F.coalesce(h["rank"], F.lit(-1)).alias("rank"), h["rule"].alias("rule"), h["verdict"].alias("verdict")) for h in found]))
        base = base.withColumn(hit, best)
    return base.withColumns({"rule": F.col(hit)["rule"], "verdict": F.coalesce(F.col(hit)["verdict"], F.lit(default))}).drop(hit)
