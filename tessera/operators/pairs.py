"""All pairs of a graph, made as they are read: what is written on the way grows with nodes and not with pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .closure import closure, materialize, tops
from .ordering import numbered, running_sums

#: Nodes that a block has at most, on either side; the pairs of two blocks are made together. Spark holds those of a run and a block.
BLOCK = 4096
#: Nodes that follow each other as b of one a, before the next a takes the same ones: columns of such short runs take little room.
RUN = 64
#: Steps that nodes may be away from the top of a tree.
ROUNDS = 64


def all_pairs(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs (a, b, depth) with b reachable from a, at the least number of steps, as ``closure`` gives them; a = b is left out.

    A node that one link leads to is reached through that link's start alone, so such nodes hang in trees. A node of a tree
    is reached from one above it by the way down, and from any other by the tree's top: at the steps to the top and
    those below it. So only what reaches the tops is searched and written, and each pair is made once, when it is read.
    Graphs in which tops are over ``ROUNDS`` steps away are left to ``closure``, which takes rounds that double.
    """
    steps = materialize(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    tree = trees(steps)
    to_tops = _to_tops(steps, tree)
    if to_tops is None:
        return closure(steps)
    return _by_tops(tree, to_tops).unionByName(_below(tree))


def trees(steps: DataFrame) -> DataFrame:
    """node, parent, top, depth, enter, leave of all nodes of ``steps`` (a, b; written): see ``ordering.numbered``.

    A node with one link to it hangs below that link's start; on circles that nothing else leads into the smallest is a top.
    """
    nodes = materialize(steps.select(F.col("a").alias("node")).union(steps.select(F.col("b").alias("node"))).distinct())
    parents = materialize(steps.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"), F.count("*").alias("n")).where("n = 1").drop("n"))
    found = materialize(tops(steps, nodes))
    circling = materialize(parents.join(found, "node", "left_anti"))
    if not circling.isEmpty():
        parents = materialize(parents.join(_smallest(circling), "node", "left_anti"))
        found = materialize(tops(parents.select(F.col("parent").alias("a"), F.col("node").alias("b")), nodes))
    placed = found.join(parents, "node", "left").select("node", "parent", "top", F.col("dist").alias("depth"), F.lit("").alias("label"))
    return materialize(numbered(placed).drop("label"))


def _smallest(parents: DataFrame) -> DataFrame:
    """node: the smallest of each circle of ``parents`` (node, parent), in which all nodes have a parent. Jumps double until each is
    longer than any way into a circle, so all end on one and see it whole from there."""
    jumps, span, n = parents.select("node", F.col("parent").alias("to"), F.col("parent").alias("least")), 1, parents.count()
    while span < n:
        further = jumps.select(F.col("node").alias("to"), F.col("to").alias("over"), F.col("least").alias("more"))
        jumps, span = materialize(jumps.join(further, "to").select("node", F.col("over").alias("to"), F.least("least", "more").alias("least"))), span * 2
    return jumps.select("node", "least").join(jumps.select(F.col("to").alias("node")).distinct(), "node").select(F.col("least").alias("node")).distinct()


def _to_tops(steps: DataFrame, tree: DataFrame) -> DataFrame | None:
    """top, node, depth: nodes that lead to the top of a tree, at the least number of steps; None if one takes over ``ROUNDS``."""
    level = materialize(tree.where("node = top").select("top", "node", F.lit(0).alias("depth")))
    seen = level
    for depth in range(1, ROUNDS + 2):
        before = steps.join(level.select("top", F.col("node").alias("b")), "b").select("top", F.col("a").alias("node")).distinct()
        level = materialize(before.join(seen, ["top", "node"], "left_anti").select("top", "node", F.lit(depth).alias("depth")))
        if level.isEmpty():
            return materialize(seen.where("depth > 0"))
        seen = seen.unionByName(level)
    return None


def _by_tops(tree: DataFrame, to_tops: DataFrame) -> DataFrame:
    """a, b, depth of nodes a that lead to the top of b and aren't above b in its tree.

    Both sides of a top are cut into blocks, and every block meets all of the other side, so neither a top that all nodes
    lead to nor a large tree is one task. A row with a run of b meets the a of one block, is unpacked where it lies, and goes.
    """
    near = to_tops.join(tree.select("node", "enter", "leave"), "node").withColumn("_one", F.lit(1))
    ranked = running_sums(near, "_one", [F.col("depth"), F.col("enter")], ["top"])
    starts = materialize(ranked.select("top", F.expr(f"(total - 1) div {BLOCK}").alias("i"), F.col("node").alias("a"), "depth", "enter", "leave"))
    runs = tree.join(starts.select("top").distinct(), "top", "left_semi").groupBy("top", F.expr(f"enter div {RUN}").alias("r"))
    runs = runs.agg(F.sort_array(F.collect_list(F.struct("depth", "enter", "node"))).alias("run"))
    runs = materialize(runs.select("top", F.expr(f"r * {RUN} div {BLOCK}").alias("j"), "run"))
    across = materialize(starts.groupBy("top").agg(F.max("i").alias("last"), F.count("*").alias("m")))
    along = materialize(runs.groupBy("top").agg(F.collect_set("j").alias("js"), F.sum(F.size("run")).alias("n")))
    blocks, made = across.join(along, "top").agg(F.sum(F.expr("(last + 1) * size(js)")), F.sum(F.expr("m * n"))).first()
    parts, met = min(2 * (blocks or 0), (made or 0) >> 20) + 1, ["top", "i", "j"]
    left = runs.join(across, "top").select("top", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("i"), "j", "run").repartition(parts, *met)
    right = starts.join(along, "top").select("top", "i", F.explode("js").alias("j"), "a", "depth", "enter", "leave").repartition(parts, *met)
    both = left.join(right.hint("shuffle_hash"), met).select("a", "depth", "enter", "leave", F.explode("run").alias("end"))
    return both.where("end.enter < enter or end.enter > leave").select("a", F.col("end.node").alias("b"), (F.col("depth") + F.col("end.depth")).alias("depth"))


def _below(tree: DataFrame) -> DataFrame:
    """a, b, depth of nodes b that hang below a: their numbers lie in a range, and ranges meet them in blocks of about their own length."""
    most = BLOCK.bit_length() - 1
    ranges = tree.where("leave > enter").withColumn("k", F.least(F.length(F.bin(F.col("leave") - F.col("enter"))), F.lit(most)))
    ranges = ranges.select("k", F.explode(F.expr("sequence(shiftright(enter + 1, k), shiftright(leave, k))")).alias("block"), F.col("node").alias("a"), F.col("enter").alias("above"), "leave", F.col("depth").alias("less"))
    inner = tree.where("depth > 0").select("node", "enter", "depth", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k"))
    inner = inner.select("k", F.expr("shiftright(enter, k)").alias("block"), F.col("node").alias("b"), "enter", "depth")
    return ranges.join(inner, ["k", "block"]).where("enter > above and enter <= leave").select("a", "b", (F.col("depth") - F.col("less")).alias("depth"))
