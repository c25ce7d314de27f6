"""Quality rules: text statistics and a learned decision list, in DataFrame functions only.

The list is learned by sequential covering. A rule is a conjunction of thresholds on statistics; it is
grown on two thirds of the labelled rows by information gain, pruned on the other third, and kept while
its precision holds; the rows it covers are set aside and the next rule is learned on the rest. What comes
out is an ordered chain of Spark ``when`` expressions that people can read.
"""

from __future__ import annotations

import bisect
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import labelled_sample

#: Bounds of the learning sample (rows of each label, smallest hash of the id first) and of the list.
ROWS_PER_LABEL, MAX_RULES, MAX_CONDITIONS, CUTS = 1500, 8, 3, 16
#: Least share of low-quality rows among those a rule covers, on the rows that pruned it, and least rows covered.
PRECISION, SUPPORT = 0.95, 5

SPACES = r"[\x20\x09-\x0D]+"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _tail(array: Column, start: int = 2) -> Column:
    """The array without what comes before ``start``; Spark's slice needs a positive length."""
    return F.slice(array, start, F.greatest(F.size(array), F.lit(1)))


def _windows(words: Column) -> Column:
    """A hash of each three consecutive words. The zeros between them keep ``a bc`` from ``ab c``."""
    pairs = F.zip_with(words, _tail(words), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    hashes = F.zip_with(pairs, _tail(words, 3), lambda ab, c: F.when(c.isNotNull(), F.xxhash64(ab["a"], F.lit(0), ab["b"], F.lit(0), c)))
    return F.slice(hashes, 1, F.greatest(F.size(words) - 2, F.lit(0)))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the statistics of ``text``; null texts have no words, and every statistic of theirs is 0.

    Repeated windows are equal neighbours in the sorted order of window hashes. The sort with places runs
    only where sorting the bare hashes has shown a repeat, as most texts have none.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    # Only the first and the last piece can be empty.
    out = docs.withColumn("_body", body).withColumn("_words", F.filter(F.split("_body", SPACES), lambda word: word != ""))
    out = out.withColumn("_windows", _windows(F.col("_words"))).withColumn("_lines", F.filter(F.split("_body", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("_sorted", F.sort_array("_windows"))
    repeated = F.exists(F.zip_with("_sorted", _tail(F.col("_sorted")), lambda a, b: a == b), lambda same: same)
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_placed", F.when(repeated, placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    # A window repeats if the one before or after it in the sorted order is equal.
    equal_next = F.zip_with("_placed", _tail(F.col("_placed")), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    starts = F.array_distinct(F.flatten(F.filter(equal_next, lambda pair: pair.isNotNull())))
    covered = F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count("_body", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": covered.cast("long"),
        "n_capitals": F.regexp_count("_body", F.lit("[A-Z]")).cast("long"),
        "n_distinct": F.size(F.array_distinct("_words")).cast("long"),
    })
    return out.drop("_body", "_words", "_windows", "_lines", "_sorted", "_placed")


def measures() -> dict[str, Column]:
    """The ratios that conditions are put on; 0 where a text has no words."""
    per = lambda name, of: F.coalesce(F.try_divide(F.col(name), F.col(of)), F.lit(0.0))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "capital_share": per("n_capitals", "word_chars"),
        "distinct_share": per("n_distinct", "n_words"),
    }


Condition = tuple[str, str, float]
Rule = list[Condition]


def holds(condition: Condition, row: dict) -> bool:
    name, sign, cut = condition
    return row[name] >= cut if sign == ">=" else row[name] <= cut


def _covered(rule: Rule, rows: list[dict]) -> list[dict]:
    return [r for r in rows if all(holds(c, r) for c in rule)]


def _low(rows: list[dict]) -> int:
    return sum(r["label"] == 0 for r in rows)


def _cuts(rows: list[dict], name: str) -> list[float]:
    values = sorted(r[name] for r in rows)
    return sorted({values[(len(values) - 1) * i // CUTS] for i in range(CUTS + 1)})


def _grow(rows: list[dict], names: list[str]) -> Rule:
    rule: Rule = []
    while len(rule) < MAX_CONDITIONS and rows and _low(rows) < len(rows):
        low, before = _low(rows), math.log2(max(_low(rows), 1) / len(rows))
        best: tuple[float, Condition] | None = None
        for name in names:
            cuts = _cuts(rows, name)
            # Counts of low and all rows for each cut, in one pass; then sums from either end.
            low_at, all_at = [0] * (len(cuts) + 1), [0] * (len(cuts) + 1)
            for r in rows:
                i = bisect.bisect_right(cuts, r[name])  # cuts[:i] are <= the value
                all_at[i] += 1
                low_at[i] += r["label"] == 0
            equal = {c: (sum(r[name] == c for r in rows), sum(r[name] == c and r["label"] == 0 for r in rows)) for c in cuts}
            for k, cut in enumerate(cuts):
                n, p = sum(all_at[k + 1 :]), sum(low_at[k + 1 :])
                below, p_below = len(rows) - n + equal[cut][0], low - p + equal[cut][1]
                for sign, n, p in ((">=", n, p), ("<=", below, p_below)):
                    if p >= SUPPORT and n < len(rows):
                        gain = p * (math.log2(p / n) - before)
                        if best is None or gain > best[0]:
                            best = (gain, (name, sign, cut))
        if best is None or best[0] <= 0:
            break
        rule.append(best[1])
        rows = _covered(rule, rows)
    return rule


def _worth(rule: Rule, rows: list[dict]) -> float:
    covered = _covered(rule, rows)
    return (2 * _low(covered) - len(covered)) / len(covered) if covered else -1.0


def _tightest(rule: Rule) -> Rule:
    """The rule with one condition for each measure and sign."""
    cuts: dict[tuple[str, str], list[float]] = {}
    for name, sign, cut in rule:
        cuts.setdefault((name, sign), []).append(cut)
    return [(name, sign, max(own) if sign == ">=" else min(own)) for (name, sign), own in cuts.items()]


def learn_list(rows: list[dict], names: list[str]) -> list[Rule]:
    """Ordered rules for low quality from rows with ``label`` (0: low), ``prune`` (bool) and the measures.

    A rule that doesn't hold on the rows that pruned it is dropped, and the next one starts from another
    measure; the list ends when no measure is left to start from.
    """
    growing, pruning, rules, left = [r for r in rows if not r["prune"]], [r for r in rows if r["prune"]], [], list(names)
    while len(rules) < MAX_RULES and _low(growing):
        rule = _grow(growing, left)
        if not rule:
            break
        start = rule[0][0]
        # Conditions go from the end as long as the rule does no worse on rows that didn't grow it.
        while len(rule) > 1 and _worth(rule[:-1], pruning) >= _worth(rule, pruning):
            rule = rule[:-1]
        grown, seen = _covered(rule, growing), _covered(rule, pruning)
        if len(grown) < SUPPORT or _low(grown) < PRECISION * len(grown) or (seen and _low(seen) < PRECISION * len(seen)):
            left = [n for n in left if n != start]
            continue
        rules.append(_tightest(rule))
        left = list(names)
        growing, pruning = ([r for r in part if not all(holds(c, r) for c in rule)] for part in (growing, pruning))
    return rules


def list_expression(rules: list[Rule], measure: dict[str, Column]) -> Column:
    """The number of the first rule that fires, from 1, or 0."""
    chain = F
    for number, rule in enumerate(rules, 1):
        met = reduce(lambda a, b: a & b, [measure[n] >= F.lit(c) if sign == ">=" else measure[n] <= F.lit(c) for n, sign, c in rule])
        chain = chain.when(met, number)
    return F.lit(0) if chain is F else chain.otherwise(0)


def learn_from(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> list[Rule]:
    """Learns the list from a bounded sample of labelled documents that aren't held out."""
    sample = labelled_sample(docs, labels, "quality", (ROWS_PER_LABEL, ROWS_PER_LABEL), doc_id, text).withColumnRenamed("_label", "label")
    prune = (F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(3)) == 0).alias("prune")
    named = measures()
    drawn = with_statistics(sample, "_text").select("label", prune, *[c.alias(n) for n, c in named.items()])
    return learn_list([r.asDict() for r in drawn.orderBy(*drawn.columns).collect()], list(named))


def judge_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and rule (that dropped it; 0: none) of every whole text.

    ``base_failed``: under 50 words, or over half of the words in repeated windows. Null texts have no words
    and fail. Without labels the list is empty and only the base rules drop. One row for each row; null ids
    are kept; further columns are left out; an empty table gives an empty result.
    """
    rules = learn_from(docs, labels, doc_id, text)
    stats = with_statistics(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = stats.select("doc_id", *BASE, failed.alias("base_failed"), list_expression(rules, measures()).alias("rule"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
