"""Splits that keep related records together."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvine.functions.text import clean
from corvine.session import cut, drop_cut

#: Components of one size are ranked in buckets of about so many.
RANK_BUCKET = 50_000
#: Sums of large components up to which they are listed.
FEW_SUMS = 1 << 14
#: Sizes of components up to which their table is broadcast.
BROADCAST_SIZES = 200_000


def key_of(c: Column) -> Column:
    """Keys are the same if they differ in case and surrounding blanks only; blank is no key."""
    return F.lower(clean(c))


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` of every node of ``edges`` (u, v: long): root is the smallest node of its component.

    Rounds of hooking and shortcutting over the parent table: every node hooks to its smallest
    neighbour (or itself), the parents are doubled (p = p(p)) until they stand still, the edges
    are rewritten to their roots and those that became loops go. In a round every node but the
    local minima gets a smaller parent, so a path is at least halved; a star loses its leaves at
    the latest in the round after its centre has hooked. The tables of each step are written to
    the checkpoint folder, and those that no later step reads are deleted. Nothing but single
    rows comes to the driver.
    """
    live = cut(edges.where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    ends = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    parents, spent = ends.select("node", F.col("node").alias("root")), []
    while live.take(1):
        both = live.union(live.select("v", "u")).toDF("node", "near")
        hooks = cut(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("up")))
        while True:
            spent.append(hooks)
            above = hooks.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            jumped = cut(hooks.join(above, "up", "left").select("node", "up", F.coalesce("upper", "up").alias("upper")))
            moved = jumped.where(F.col("up") != F.col("upper")).take(1)
            hooks = jumped.select("node", F.col("upper").alias("up"))
            if not moved:
                break
        spent += [hooks, live]
        u, v = hooks.toDF("u", "ru"), hooks.toDF("v", "rv")
        lifted = live.join(u, "u", "left").join(v, "v", "left").select(F.coalesce("ru", "u").alias("a"), F.coalesce("rv", "v").alias("b"))
        lower = cut(lifted.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        raised = cut(parents.join(hooks.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        for table in spent:
            drop_cut(table)
        live, parents, spent = lower, raised, [raised]
    return parents


def related(df: DataFrame, row_id: str, keys: list[str]) -> DataFrame:
    """The columns of ``df`` but ``keys``, and ``component``: rows that share one of ``keys``, directly or through other rows, have the same.

    The nodes are the distinct key values, named by the smallest row that holds them, so an edge
    (a row with two keys) is a pair of numbers and a key that a third of the rows share is one
    node. Rows are named by their ids while keys are joined, null keys take no part in a join. A
    row without any key is a component of its own, named by its id.
    """
    others = [c for c in df.columns if c not in keys]
    keyed = df.select(*others, *(key_of(F.col(k)).alias(f"__key_{i}") for i, k in enumerate(keys)))
    for i in range(len(keys)):
        key = F.col(f"__key_{i}")
        # 2 id, 2 id + 1, ... : a node of each kind of key, and the ids stay comparable
        node = keyed.where(key.isNotNull()).groupBy(key.alias("__key")).agg((F.min(row_id) * len(keys) + i).alias("__node"))
        held = keyed.where(key.isNotNull()).withColumn("__key", key).join(node, "__key").drop("__key", f"__key_{i}").withColumnRenamed("__node", f"__node_{i}")
        keyed = held.unionByName(keyed.where(key.isNull()).drop(f"__key_{i}").withColumn(f"__node_{i}", F.lit(None).cast(held.schema[f"__node_{i}"].dataType)))
    named = cut(keyed)
    columns = [F.col(f"__node_{i}") for i in range(len(keys))]
    first = F.coalesce(*columns)
    edges = reduce(DataFrame.union, [named.where(c.isNotNull()).select(first.alias("u"), c.alias("v")) for c in columns]).distinct()
    roots = components(edges).toDF("__first", "__root")
    tied = named.where(first.isNotNull()).withColumn("__first", first).join(roots, "__first").withColumn("component", F.col("__root"))
    own = named.where(first.isNull()).withColumn("component", F.coalesce(F.lit(-1) - F.col(row_id), F.lit(-(2**63))))
    return tied.select(*others, "component").unionByName(own.select(*others, "component"))


def leaks(rows: DataFrame, split: str) -> DataFrame:
    """The rows of every component with more than one split (case and blanks aside; blank is no split)."""
    bad = rows.groupBy("component").agg(F.min(key_of(F.col(split))).alias("low"), F.max(key_of(F.col(split))).alias("high")).where(F.col("low") != F.col("high"))
    return rows.join(bad.select("component"), "component", "left_semi")


def _bitset(sizes: dict[int, int], low: int, high: int) -> dict[int, int]:
    """How many components of each size to take so that their sum lies in [low, high] or as near to it as possible.

    Bit i of a Python integer says that the sum i can be reached. The multiplicity of a size is
    cut into powers of two, so a size with m components needs log m shifts.
    """
    mask = (1 << (max(high, 0) + max(sizes, default=0) + 1)) - 1
    reach, steps = 1, []
    for size in sorted(sizes, reverse=True):
        left, part = sizes[size], 1
        while left > 0:
            n = min(part, left)
            steps.append((size, n, reach))
            reach = (reach | reach << (size * n)) & mask
            left, part = left - n, part * 2
    high, low = max(high, 0), max(low, 0)
    below = (reach & ((1 << (high + 1)) - 1)).bit_length() - 1
    above = reach >> high
    over = high + (above & -above).bit_length() - 1 if above else below
    at = below if below >= low or low - below <= over - high else over
    taken: dict[int, int] = {}
    for size, n, before in reversed(steps):
        if not before >> at & 1:
            at -= size * n
            taken[size] = taken.get(size, 0) + n
    return taken


def _few(sizes: dict[int, int], low: int, high: int) -> dict[int, int]:
    """As ``_bitset`` for a handful of components, whose sums are listed instead of marked in a row of bits as long as the target."""
    low, high = max(low, 0), max(high, 0)
    sums: dict[int, dict[int, int]] = {0: {}}
    for size, m in sizes.items():
        sums |= {s + size * n: taken | {size: n} for s, taken in list(sums.items()) for n in range(1, m + 1) if s + size * n not in sums}
    return sums[min(sums, key=lambda s: (max(low - s, s - high, 0), -s))]


def choose(sizes: dict[int, int], target: int) -> dict[int, int]:
    """How many components of each size to take so that the sum comes as close to ``target`` as possible.

    The smallest sizes, as long as none is larger than all smaller ones together and one, reach
    every sum up to their total, so they close any gap exactly, the largest that fits first. The
    bitset runs over the remaining sizes only, and its window is as wide as that total. Each of
    the remaining components is larger than all the closing ones together, so they are few
    unless the closing ones are.
    """
    fill, closing = 0, {}
    for size in sorted(s for s, m in sizes.items() if m > 0):
        if size > fill + 1:
            break
        closing[size] = sizes[size]
        fill += size * sizes[size]
    target = max(0, min(target, sum(s * m for s, m in sizes.items())))
    large = {s: m for s, m in sizes.items() if m > 0 and s not in closing}
    taken = (_few if math.prod(m + 1 for m in large.values()) <= FEW_SUMS else _bitset)(large, target - fill, target)
    left = target - sum(s * m for s, m in taken.items())
    for size in sorted(closing, reverse=True):
        n = min(closing[size], max(left, 0) // size)
        if n:
            taken[size] = n
            left -= n * size
    return taken


def assign(rows: DataFrame, targets: list[tuple[str, float]]) -> DataFrame:
    """``rows`` with ``component`` get ``new_split``; whole components go to one split, totals as near to the shares as they can be.

    Only the histogram of component sizes comes to the driver: at most sqrt(2 n) rows. The
    components of one size are ranked by a hash inside buckets of bounded size, and the ranks are
    cut where the choice says. An empty table gives an empty result; shares are normalised.
    """
    spark = rows.sparkSession
    # a size has a row; only a table that stays below the bound is sent to every executor
    small = lambda df, n: F.broadcast(df) if n <= BROADCAST_SIZES else df
    members = cut(rows.groupBy("component").agg(F.count("*").alias("size")).withColumn("h", F.xxhash64("component")))
    sizes = {r["size"]: r["count"] for r in members.groupBy("size").count().collect()}
    n_rows, share = sum(s * m for s, m in sizes.items()), sum(t[1] for t in targets) or 1.0
    open_sizes, cuts, used = dict(sizes), [], {s: 0 for s in sizes}
    ordered = sorted(targets, key=lambda t: (-t[1], t[0]))
    for k, (name, part) in enumerate(ordered):
        taken = choose(open_sizes, round(n_rows * part / share)) if k + 1 < len(ordered) else dict(open_sizes)
        for s, n in taken.items():
            cuts.append((s, used[s], used[s] + n, name))
            used[s] += n
            open_sizes[s] -= n
    if not cuts:
        return rows.withColumn("new_split", F.lit(None).cast("string"))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("of_size") / RANK_BUCKET))
    of_size = spark.createDataFrame(list(sizes.items()), "size long, of_size long")
    placed = members.join(small(of_size, len(sizes)), "size").withColumn("bucket", F.pmod("h", buckets))
    offsets = placed.groupBy("size", "bucket").count().withColumn("before", F.sum("count").over(Window.partitionBy("size").orderBy("bucket")) - F.col("count"))
    within = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("h", "component"))
    ranked = placed.withColumn("rn", within).join(offsets.drop("count"), ["size", "bucket"]).withColumn("rank", F.col("before") + F.col("rn") - 1)
    table = spark.createDataFrame(cuts, "size long, low long, high long, new_split string")
    # at most one row a size and split: joined on the size, then the range picks one
    chosen = ranked.join(small(table, len(cuts)), "size").where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).select("component", "new_split")
    return rows.join(chosen, "component")
