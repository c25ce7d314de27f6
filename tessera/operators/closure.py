"""Fixpoints: transitive closure, searches that stop, linked lists, trees of blank nodes, strongly connected components."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..vocab import iri

#: Only for sessions that name no shared folder, such as unit tests.
FALLBACK_DIR = "/tmp/tessera-checkpoints"


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder, so that loops don't grow their plans.

    It is written as Parquet and read back: a later plan reads only the columns, and of triples the predicates, that it
    asks for, and Spark knows how large the table is. A checkpoint of rows is read whole each time.
    """
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    set_ = context._jsc.sc().getCheckpointDir()
    base = set_.get() if set_.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = FALLBACK_DIR
    path = f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a doubling round may make besides twice the pairs that are known.
DOUBLING_ROWS = 1_000_000


def closure(edges: DataFrame, a: str = "a", b: str = "b", roots: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b, depth) with b reachable from a, at the least number of steps; cycles end, a = b is left out.

    With ``roots`` (a column ``a``) only pairs that start there. All pairs up to a depth are known after a round, and
    what lies beyond starts with a pair of exactly that depth: these go on, by a step, or by all known pairs where
    that makes few rows, as in trees and chains. Pairs that are known already are dropped by an anti-join.
    """
    steps = materialize(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct().withColumn("depth", F.lit(1)))
    known = steps if roots is None else steps.join(roots.select("a").distinct(), "a", "left_semi")
    depth = 1
    while True:
        last = known.where(F.col("depth") == depth)
        double = roots is None and depth > 1 and _rows_made(last, known) <= DOUBLING_ROWS + 2 * known.count()
        further = (known if double else steps).select(F.col("a").alias("m"), F.col("b").alias("end"), F.col("depth").alias("more"))
        longer = last.join(further, last["b"] == F.col("m")).where("a <> end").groupBy("a", F.col("end").alias("b")).agg((F.min("more") + depth).alias("depth"))
        new = materialize(longer.join(known.select("a", "b"), ["a", "b"], "left_anti"))
        if new.isEmpty():
            return known
        known, depth = known.unionByName(new), depth * 2 if double else depth + 1


def _rows_made(last: DataFrame, known: DataFrame) -> int:
    """How many rows a join of ``last`` with ``known`` makes."""
    ends = last.groupBy("b").agg(F.count("*").alias("n"))
    starts = known.groupBy("a").agg(F.count("*").alias("k"))
    return ends.join(starts, ends["b"] == starts["a"]).agg(F.sum(F.expr("n * k"))).first()[0] or 0


#: Rounds in which chosen lists are walked node by node.
WALKED = 32


def list_items(triples: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Linked lists of the graph: head, idx (from 1), item, item_kind. Cyclic lists have no head and no rows.

    With ``heads`` (head) only lists that start there: they are walked from their heads, a node a round, so other lists cost a
    scan. All lists, and chosen ones of over ``WALKED`` nodes, are ranked: every node jumps towards its head, and jumps
    double in length with every round. Nodes whose jump ends at a head leave the rounds.
    """
    firsts = triples.where(F.col("p") == iri("rdf:first")).select(F.col("s").alias("node"), F.col("o").alias("item"), F.col("o_kind").alias("item_kind"))
    steps = triples.where((F.col("p") == iri("rdf:rest")) & (F.col("o") != iri("rdf:nil"))).select(F.col("o").alias("node"), F.col("s").alias("up"))
    if heads is not None:
        walked = _walked_lists(steps, heads.select("head").where("head is not null").distinct())
        if walked is not None:
            return walked.join(_among(firsts, walked, "node"), "node").distinct().select("head", "idx", "item", "item_kind")
    firsts, steps = firsts.distinct(), materialize(steps.distinct())
    known = steps.select(F.col("node").alias("up")).distinct().withColumn("is_inner", F.lit(True))
    jumps = materialize(steps.join(known, "up", "left").select("node", "up", F.lit(1).alias("dist"), F.col("is_inner").isNull().alias("at_head")))
    done, going = [jumps.where("at_head")], jumps.where("not at_head")
    open_, before = going.count(), -1
    while open_ not in (0, before):
        further = jumps.select(F.col("node").alias("up"), F.col("up").alias("top"), F.col("dist").alias("more"), F.col("at_head").alias("ends"))
        going = materialize(going.join(further, "up").select("node", F.col("top").alias("up"), (F.col("dist") + F.col("more")).alias("dist"), F.col("ends").alias("at_head")))
        done.append(going.where("at_head"))
        going = going.where("not at_head")
        jumps = _all([*done, going], "", steps)
        before, open_ = open_, going.count()
    inner = materialize(_all(done, "", steps).select("node", "up", "dist"))
    placed = firsts.join(inner, "node").select(F.col("up").alias("head"), (F.col("dist") + 1).alias("idx"), "item", "item_kind")
    at_top = firsts.join(steps.select("node"), "node", "left_anti").select(F.col("node").alias("head"), F.lit(1).alias("idx"), "item", "item_kind")
    placed = placed.unionByName(at_top)
    return placed if heads is None else placed.join(heads.select("head").distinct(), "head", "left_semi")


#: Keys from which on ``_among`` asks for a join by hash.
MANY_KEYS = 100_000


def _among(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """``rows`` whose ``column`` is among those of the written table ``keys``, of which there are far fewer: few go to all tasks by Spark's
    own choice; of more each task hashes a share, each once, so that the many rows needn't be sorted."""
    wanted = keys.select(column).distinct()
    return rows.join(wanted.hint("shuffle_hash") if keys.count() > MANY_KEYS else wanted, column, "left_semi")


def _walked_lists(steps: DataFrame, heads: DataFrame) -> DataFrame | None:
    """node, head, idx of the lists that start at ``heads`` over ``steps`` (node, up); None if one goes on for too long."""
    heads = materialize(heads)
    inner = materialize(steps.select("node").join(heads.select(F.col("head").alias("node")), "node", "left_semi").distinct())
    level = materialize(heads.join(inner, heads["head"] == inner["node"], "left_anti").select(F.col("head").alias("node"), "head", F.lit(1).alias("idx")))
    found = [level]
    for idx in range(2, WALKED + 2):
        ends = level.select(F.col("node").alias("up"), "head")
        level = materialize(_among(steps, ends, "up").join(ends, "up").distinct().select("node", "head", F.lit(idx).alias("idx")))
        if level.isEmpty():
            return materialize(_all(found, "", steps))
        found.append(level)
    return None

# ------------------------------------------------------------------ searches that stop, trees, components


def _directed(edges: DataFrame, direction: str) -> DataFrame:
    """a, b of steps ``up`` (from a to b), ``down`` or ``both``."""
    up = edges.select("a", "b").where("a <> b").distinct()
    down = up.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return {"up": up, "down": down, "both": up.unionByName(down).distinct()}[direction]


def search(edges: DataFrame, starts: DataFrame, marked: DataFrame, pick: str, direction: str = "up", key: list[str] | None = None) -> DataFrame:
    """id, ``pick``, depth: for each start (id) the smallest ``pick`` among the ``marked`` (id, pick) nodes at the least depth.

    Marks are handed on against the direction, a step a round, and a node takes the first that it is offered: so it is in
    one round alone, however many starts lead through it, and rounds end when all starts have one. With ``key``
    columns of few values, in starts and marked, only nodes marked under a start's key count. A start isn't its own hit;
    starts that are marked themselves walk on their own, as they might meet their own mark on a circle.
    """
    key = key or []
    steps = materialize(_directed(edges, direction))
    marks = materialize(marked.groupBy("id", *key).agg(F.min(pick).alias(pick)))
    begun = materialize(starts.select("id", *key).distinct().join(marks.select("id", *key, F.lit(True).alias("own")), ["id", *key], "left"))
    found = _handed_on(steps, begun.where("own is null").drop("own"), marks, pick, key)
    own = begun.where("own").drop("own")
    if not own.isEmpty():
        found += _walked(steps, own, marks, pick, key)
    # One table: a join with a union goes into its branches, and one task would sort for all depths at once.
    return materialize(_all(found, f"id {dict(starts.dtypes)['id']}, {''.join(f'{k} {dict(starts.dtypes)[k]}, ' for k in key)}{pick} {dict(marked.dtypes)[pick]}, depth int", starts))


def _handed_on(steps: DataFrame, starts: DataFrame, marks: DataFrame, pick: str, key: list[str]) -> list[DataFrame]:
    """Hits, a frame a depth, of the unmarked ``starts``. Steps from nodes that have a hit are dropped once they are a quarter."""
    at = ["id", *key]
    wide = steps.crossJoin(starts.select(*key).distinct()) if key else steps
    open_ = wide.withColumnRenamed("a", "id").join(marks.select(*at), at, "left_anti").join(starts.withColumn("is_start", F.lit(True)), at, "left")
    open_ = materialize(open_.select(*at, "b", F.coalesce("is_start", F.lit(False)).alias("is_start")))
    rows, left, level, found, since, depth = open_.count(), starts.count(), marks, [], [], 0
    while left and rows:
        depth += 1
        offered = open_.join(level.select(F.col("id").alias("b"), *key, pick), ["b", *key]).groupBy(*at).agg(F.min(pick).alias(pick), F.max("is_start").alias("is_start"))
        for done in since:
            offered = offered.join(done.select(*at), at, "left_anti")
        level = materialize(offered)
        n = level.count()
        if not n:
            break
        hits = level.where("is_start")
        found.append(hits.select(*at, pick, F.lit(depth).alias("depth")))
        left, since = left - hits.count(), [_all([*since, level.select(*at)], "", level)]
        if since[0].count() * 4 >= rows:
            open_, since = materialize(open_.join(since[0], at, "left_anti")), []
            rows = open_.count()
    return found


def _walked(steps: DataFrame, starts: DataFrame, marks: DataFrame, pick: str, key: list[str]) -> list[DataFrame]:
    """Hits, a frame a depth: all starts go on side by side, and a start leaves at its first hit."""
    frontier = materialize(starts.withColumn("node", F.col("id")))
    seen, found, depth = frontier, [], 0
    while not frontier.isEmpty():
        depth += 1
        ahead = frontier.join(steps, frontier["node"] == steps["a"]).select("id", *key, F.col("b").alias("node")).distinct()
        ahead = materialize(ahead.join(seen, ["id", *key, "node"], "left_anti"))
        found.append(materialize(ahead.join(marks.withColumnRenamed("id", "node"), ["node", *key]).groupBy("id", *key).agg(F.min(pick).alias(pick)).withColumn("depth", F.lit(depth))))
        frontier = materialize(ahead.join(found[-1].select("id", *key), ["id", *key], "left_anti"))
        seen = seen.unionByName(frontier)
    return found


def _all(frames: list[DataFrame], schema: str, like: DataFrame) -> DataFrame:
    out = frames[0] if frames else like.sparkSession.createDataFrame([], schema)
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def tops(links: DataFrame, within: DataFrame) -> DataFrame:
    """node, top, dist for the nodes ``within`` (node): a node that one link (a, b) leads to, from another node ``within``, is
    reached exactly if that one is, so it shares its top, ``dist`` links above it; all others are their own. Nodes of cycles that nothing
    leads into have none. Jumps double, so a chain of n nodes takes log n rounds, and nodes whose jump ends at a top leave them."""
    known = materialize(within.select("node").distinct())
    one = links.groupBy("b").agg(F.min("a").alias("up"), F.max("a").alias("last")).where("up = last and up <> b").select(F.col("b").alias("node"), "up")
    steps = materialize(one.join(known, "node", "left_semi").join(known.withColumnRenamed("node", "up"), "up", "left_semi").select("node", "up"))
    own = known.join(steps.select("node"), "node", "left_anti").select("node", F.col("node").alias("top"), F.lit(0).alias("dist"))
    return own.unionByName(_hung(steps))


def _hung(steps: DataFrame) -> DataFrame:
    """node, top, dist of the nodes that hang (node, up; written, each once) below others, save those of cycles."""
    inner = steps.select(F.col("node").alias("up"), F.lit(True).alias("is_inner"))
    jumps = materialize(steps.join(inner, "up", "left").select("node", "up", F.lit(1).alias("dist"), F.col("is_inner").isNull().alias("at_top")))
    done, going = [jumps.where("at_top")], jumps.where("not at_top")
    open_, before = going.count(), -1
    while open_ not in (0, before):
        further = jumps.select(F.col("node").alias("up"), F.col("up").alias("over"), F.col("dist").alias("more"), F.col("at_top").alias("ends"))
        going = materialize(going.join(further, "up").select("node", F.col("over").alias("up"), (F.col("dist") + F.col("more")).alias("dist"), F.col("ends").alias("at_top")))
        done.append(going.where("at_top"))
        going = going.where("not at_top")
        jumps = _all([*done, going], "", steps)
        before, open_ = open_, going.count()
    return _all(done, "", steps).select("node", F.col("up").alias("top"), "dist")


def spread(links: DataFrame) -> DataFrame:
    """root, node: the inner nodes that each root reaches over ``links`` (a, b, is_inner; written). b is always an inner node, a
    is one if ``is_inner``, else a root.

    Trees are gone through at their tops, so that a list of n nodes costs n rows and not n squared; rounds go on only
    where nodes are shared. A node that a root leads to is its own top, as it has that link besides those from inner nodes.
    """
    met = materialize(links.groupBy("b").agg(F.min("a").alias("up"), F.max("a").alias("last"), F.max("is_inner").alias("is_inner")).select(F.col("b").alias("node"), "up", "is_inner", (F.col("is_inner") & (F.col("up") == F.col("last")) & (F.col("up") != F.col("b"))).alias("hangs")))
    hung = materialize(_hung(met.where("hangs").select("node", "up")).select("node", "top"))
    # A node that isn't its own top shares that of the one that leads to it, so only links into tops lead on.
    tops_met = met.where("is_inner and not hangs").select(F.col("node").alias("b"))
    into = links.where("is_inner").select("a", "b").join(tops_met, "b", "left_semi")
    over = into.join(hung.withColumnRenamed("node", "a"), "a", "left").select(F.coalesce("top", "a").alias("a"), "b")
    between = materialize(over.where("a <> b").distinct())
    seen = frontier = materialize(links.where("not is_inner").select(F.col("a").alias("root"), F.col("b").alias("top")).distinct())
    while not (between.isEmpty() or frontier.isEmpty()):
        ahead = frontier.join(between, frontier["top"] == between["a"]).select("root", F.col("b").alias("top")).distinct()
        frontier = materialize(ahead.join(seen, ["root", "top"], "left_anti"))
        seen = seen.unionByName(frontier)
    return seen.select("root", F.col("top").alias("node")).unionByName(seen.join(hung, "top").select("root", "node"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node): strongly connected components of the nodes of ``edges`` (a, b).

    Nodes that nothing leads to, or that lead nowhere, are components alone and are trimmed. Among the others each takes
    the smallest node that reaches it; those that also reach that node are its component. Then what is left goes on.
    Every round starts from what changed in the last.
    """
    whole = materialize(edges.select("a", "b").where("a <> b").distinct())
    nodes = materialize(edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct())
    left, settled = whole, []
    while not left.isEmpty():
        core = left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        core = materialize(core.join(core.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
        rest, before = core.count(), left.count()
        if rest <= 0.9 * before:  # else a long chain would be taken off link by link
            left = core
            continue
        left = core
        if not rest:
            break
        colour = materialize(left.select(F.col("a").alias("node"), F.col("a").alias("colour")).distinct())
        changed = colour
        while not changed.isEmpty():
            offered = changed.join(left, changed["node"] == left["a"]).groupBy(F.col("b").alias("node")).agg(F.min("colour").alias("offer"))
            merged = materialize(colour.join(offered, "node", "left").select("node", F.least("colour", F.coalesce("offer", "colour")).alias("colour"), (F.col("offer") < F.col("colour")).alias("is_new")))
            colour, changed = merged.select("node", "colour"), merged.where("is_new").select("node", "colour")
        of = lambda side: colour.select(F.col("node").alias(side), F.col("colour").alias(f"{side}_colour"))
        inside = materialize(left.join(of("a"), "a").join(of("b"), "b").where("a_colour = b_colour").select("a", "b"))
        frontier = materialize(colour.where("node = colour"))
        member = frontier
        while not frontier.isEmpty():
            back = frontier.join(inside, frontier["node"] == inside["b"]).select(F.col("a").alias("node"), "colour").distinct()
            frontier = materialize(back.join(member, ["node", "colour"], "left_anti"))
            member = member.unionByName(frontier)
        settled.append(materialize(member))
        done = settled[-1].select("node")
        left = materialize(left.join(done.withColumnRenamed("node", "a"), "a", "left_anti").join(done.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"))
    several = _all(settled, "node string, colour string", nodes)
    return nodes.join(several, "node", "left").select("node", F.coalesce("colour", "node").alias("component"))
