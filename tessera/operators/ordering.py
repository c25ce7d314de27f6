"""Orders over whole tables: running sums, row numbers and pre-order numbers of forests, without a window over all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .closure import materialize

#: Rows that one range of a running sum has about.
RANGE_ROWS = 1_000_000
#: Depths up to which forests are numbered depth by depth.
DEPTHS = 64


def running_sums(rows: DataFrame, value: str, order: list[Column], by: list[str] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with ``total``: the sum of ``value`` from the first row in ``order`` to this one, for each group ``by``.

    Rows are parted into ranges of the order, each range is summed, and a range starts with the sum of those before it in
    its group. So no task has more than a range, however large a group is; the sums of ranges are at most one a range
    and group. ``order`` must tell rows of a group apart. Null values count as 0.
    """
    by = by or []
    ranges = rows.count() // range_rows + 1
    parted = materialize(rows.repartitionByRange(ranges, *by, *order).withColumn("_range", F.spark_partition_id()))
    keys = [*by, "_range"]
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = parted.groupBy(*keys).agg(F.sum(F.coalesce(value, F.lit(0))).alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(k).alias(f"_{k}") for k in keys], F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    met = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by] + [F.col("_range") == F.col("__range")]
    summed = parted.withColumn("_within", F.sum(F.coalesce(value, F.lit(0))).over(within)).join(starts, met)
    return summed.select(*rows.columns, (F.col("_within") + F.col("_before")).alias("total"))


def spanning_forest(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, parent, depth of all ``nodes`` (id) that a root reaches by ``links`` (child, parent).

    Roots are the nodes without a parent. A node gets its least depth and, of its parents one step higher, the
    smallest. A round goes on from the nodes of the last depth, and a node is in one round alone, so cycles end.
    """
    level = materialize(nodes.select("id").distinct().join(links.select(F.col("child").alias("id")), "id", "left_anti").select(F.col("id").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth")))
    found = level
    while not level.isEmpty():
        below = links.join(level.select(F.col("node").alias("parent"), "depth"), "parent").groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("parent"), (F.max("depth") + 1).alias("depth"))
        level = materialize(below.join(found.select("node"), "node", "left_anti"))
        found = found.unionByName(level)
    return found


def numbered(forest: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``forest`` (node, parent, depth, label) with ``enter`` and ``leave``: pre-order numbers from 1, siblings by label and node.

    A node lies below another if its ``enter`` is above the other's ``enter`` and at most the other's ``leave``. Forests of
    few depths are counted depth by depth, so a node is in two rounds; deep ones by ranking a tour, in rounds that
    grow with the logarithm of the nodes. Siblings are numbered by running sums, so there are no hot parents.
    """
    forest = materialize(forest)
    deepest = forest.agg(F.max("depth")).first()[0]
    ranks = _by_depth(forest, deepest or 0, range_rows) if (deepest or 0) <= DEPTHS else _by_tour(forest, range_rows)
    return forest.join(ranks, "node")


def _siblings() -> list[Column]:
    return [F.col("parent").asc_nulls_first(), F.col("label").asc_nulls_first(), F.col("node")]


def _by_depth(forest: DataFrame, deepest: int, range_rows: int) -> DataFrame:
    """node, enter, leave: sizes from the deepest nodes up, then numbers from the roots down."""
    sized, below = [], None
    for depth in range(deepest, -1, -1):
        level = forest.where(F.col("depth") == depth).select("node", "parent", "depth", "label")
        if below is None:
            level = level.withColumn("size", F.lit(1).cast("long"))
        else:
            level = level.join(below.groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("inner")), "node", "left").withColumn("size", F.coalesce("inner", F.lit(0)) + 1).drop("inner")
        below = materialize(level)
        sized.append(below)
    sums = running_sums(reduce(DataFrame.unionByName, sized), "size", _siblings(), range_rows=range_rows).withColumn("start", F.col("total") - F.col("size"))
    sums = materialize(sums.select("node", "parent", "depth", "size", "start"))
    firsts = sums.groupBy(F.col("parent").alias("_parent")).agg(F.min("start").alias("first"))
    placed = materialize(sums.join(firsts, F.col("parent").eqNullSafe(F.col("_parent"))).select("node", "parent", "depth", "size", (F.col("start") - F.col("first") + 1).alias("step")))
    above, entered = None, []
    for depth in range(deepest + 1):
        level = placed.where(F.col("depth") == depth)
        if above is None:
            level = level.select("node", F.col("step").alias("enter"), "size")
        else:
            level = level.join(above.select(F.col("node").alias("parent"), "enter"), "parent").select("node", (F.col("enter") + F.col("step")).alias("enter"), "size")
        above = materialize(level)
        entered.append(above)
    return reduce(DataFrame.unionByName, entered).select("node", "enter", (F.col("enter") + F.col("size") - 1).alias("leave"))


def _by_tour(forest: DataFrame, range_rows: int) -> DataFrame:
    """node, enter, leave: the tour around the forest is a linked list of an entry and an exit for each node, which is ranked
    by jumps that double in length. Each event is jumped to by one other, so there are no hot keys.
    """
    placed = materialize(running_sums(forest.withColumn("_one", F.lit(1)), "_one", _siblings(), range_rows=range_rows).select("node", "parent", F.col("total").alias("place")))
    following = placed.select((F.col("place") - 1).alias("place"), F.col("parent").alias("_parent"), F.col("node").alias("sibling"))
    first = placed.groupBy("parent").agg(F.min_by("node", "place").alias("first")).where("parent is not null").select(F.col("parent").alias("node"), "first")
    around = placed.join(following, "place", "left").withColumn("sibling", F.when(F.col("parent").eqNullSafe(F.col("_parent")), F.col("sibling"))).join(first, "node", "left")
    entry, exit_ = lambda c: F.concat(F.lit("+"), c), lambda c: F.concat(F.lit("-"), c)
    goes_in = around.select(entry(F.col("node")).alias("event"), F.coalesce(entry(F.col("first")), exit_(F.col("node"))).alias("to"), F.lit(1).cast("long").alias("entries"))
    goes_out = around.select(exit_(F.col("node")).alias("event"), F.coalesce(entry(F.col("sibling")), exit_(F.col("parent"))).alias("to"), F.lit(0).cast("long").alias("entries"))
    tour = materialize(goes_in.unionByName(goes_out))
    while not tour.where("to is not null").isEmpty():
        ahead = tour.select(F.col("event").alias("to"), F.col("to").alias("_to"), F.col("entries").alias("_entries"))
        tour = materialize(tour.join(ahead, "to", "left").select("event", F.col("_to").alias("to"), (F.col("entries") + F.coalesce("_entries", F.lit(0))).alias("entries")))
    # Entries are those from an event to the end, itself included.
    n = forest.count()
    name, sign = F.substring("event", 2, 1 << 30), F.substring("event", 1, 1)
    return tour.groupBy(name.alias("node")).agg((F.lit(n + 1) - F.max(F.when(sign == "+", F.col("entries")))).alias("enter"), (F.lit(n) - F.max(F.when(sign == "-", F.col("entries")))).alias("leave"))
