"""Ordered rows: folds with constant memory, limits in anchored windows, unique assignment, order-keeping unions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corvine.session import cut


def fold(df: DataFrame, key: str, order: list[str], start: Callable, step: Callable, result: T.StructType) -> DataFrame:
    """A sequential fold over the rows of each key in order.

    ``step(state, row) -> (state, outputs)``; ``start()`` makes a key's first state. Rows are
    dealt by key, sorted on disk if need be and streamed: a task holds one batch and one state,
    however many rows a key has. ``row`` is a tuple of the columns of ``df``, ``outputs`` of ``result``.
    """
    at = df.columns.index(key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, none_yet = None, None, True
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                own = None if pd.isna(row[at]) else row[at]
                if none_yet or own != current:
                    current, state, none_yet = own, start(), False
                state, outputs = step(state, row)
                out.append(outputs)
            yield pd.DataFrame(out, columns=result.names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, result)


def anchored_limit(df: DataFrame, key: str, time: str, row_id: str, seconds: float, limit: int) -> DataFrame:
    """row_id, window_start, is_allowed: at most ``limit`` rows in a window that the key's first row opens; a row at or after its end opens the next; refused rows neither count nor prolong."""
    names = [key, time, row_id]
    rows = df.select(F.col(key), F.col(time).cast("timestamp").alias(time), F.col(row_id)).where(F.col(time).isNotNull())
    length = pd.Timedelta(seconds=seconds)

    def step(state: tuple, row: tuple) -> tuple:
        begin, used = state
        now = row[names.index(time)]
        if begin is None or now >= begin + length:
            begin, used = now, 0
        allowed = used < limit
        return (begin, used + allowed), (row[names.index(row_id)], begin, allowed)

    result = T.StructType([T.StructField(row_id, df.schema[row_id].dataType), T.StructField("window_start", T.TimestampType()), T.StructField("is_allowed", T.BooleanType())])
    return fold(rows, key, [time, row_id], lambda: (None, 0), step, result)


def alternating(df: DataFrame, key: str, order: str, role: str, roles: tuple[str, ...]) -> DataFrame:
    """order, kept position: the rows kept when the k-th kept row of a key must have the role number k modulo the number of roles."""
    rows = df.select(key, order, role)

    def step(n: int, row: tuple) -> tuple:
        keep = row[2] == roles[n % len(roles)]
        return n + keep, (row[1], n if keep else -1)

    result = T.StructType([T.StructField(order, df.schema[order].dataType), T.StructField("position", T.LongType())])
    return fold(rows, key, [order], lambda: 0, step, result).where(F.col("position") >= 0)


def within_budget(df: DataFrame, key: str, order: list[str], item: str, price: str, budget: float) -> DataFrame:
    """item, spent: items taken in order as long as the key's budget allows; one that is too dear is passed over."""
    rows = df.select(key, *order, item, price)
    at_item, at_price = len(order) + 1, len(order) + 2

    def step(spent: float, row: tuple) -> tuple:
        take = spent + row[at_price] <= budget
        spent += row[at_price] if take else 0
        return spent, (row[at_item], spent if take else -1.0)

    result = T.StructType([T.StructField(item, df.schema[item].dataType), T.StructField("spent", T.DoubleType())])
    return fold(rows, key, order, lambda: 0.0, step, result).where(F.col("spent") >= 0)


def assign_once(pairs: DataFrame, room: DataFrame | None = None) -> DataFrame:
    """left, right, score, place: each left, in ascending order, takes the best right (score, then smallest) that is not full yet.

    ``room``: right, room (how many lefts it takes; 1 without a table). The sequential choice is
    reached in parallel: every left proposes to its best right, a right keeps the smallest lefts,
    pairs of larger ones with a full right go, until nobody is refused. ``place`` numbers the
    lefts of a right from 1. Repeated pairs count with their best score.
    """
    best = pairs.groupBy("left", "right").agg(F.max("score").alias("score"))
    open_pairs = cut(best.join(room, "right") if room is not None else best.withColumn("room", F.lit(1)))
    while True:
        order = F.struct(-F.col("score"), F.col("right"))
        proposals = open_pairs.groupBy("left").agg(F.min_by(F.struct("right", "score", "room"), order).alias("p")).select("left", "p.*")
        judged = cut(proposals.withColumn("place", F.row_number().over(Window.partitionBy("right").orderBy("left"))))
        if not judged.where(F.col("place") > F.col("room")).take(1):
            return judged.select("left", "right", "score", "place")
        # a right that is full never takes a left beyond its last one, so all such pairs go at once
        full = judged.where(F.col("place") == F.col("room")).select("right", F.col("left").alias("last"))
        open_pairs = cut(open_pairs.join(full, "right", "left").where(F.col("last").isNull() | (F.col("left") <= F.col("last"))).select("left", "right", "score", "room"))


def ordered_union(lists: list[DataFrame], key: str, order: str) -> DataFrame:
    """Rows of several ordered lists, those of the first list first; of each key the first occurrence with its list and place."""
    tagged = reduce(DataFrame.unionByName, [d.select(key, F.lit(i).alias("list"), F.col(order).alias("place")) for i, d in enumerate(lists)])
    return tagged.groupBy(key).agg(F.min(F.struct("list", "place")).alias("p")).select(key, "p.list", "p.place")


def changed(df: DataFrame, key: str, order: list[str], value: str) -> Column:
    """Whether the value differs from the row before; true for the first row."""
    return F.coalesce(F.col(value) != F.lag(value).over(Window.partitionBy(key).orderBy(*order)), F.lit(True))


def nearest_rank(df: DataFrame, value: str, share: float) -> DataFrame:
    """The value at index round(share * (n - 1)) (half to even) of the sorted values: one row ``value``, none without values."""
    counted = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n"))
    total = counted.agg(F.sum("__n").alias("n")).first().n
    if not total:
        return df.select(F.lit(None).cast("double").alias("value")).limit(0)
    wanted = round(share * (total - 1))
    # equal values are one row; ranges of values are numbered on their own and shifted by the sizes of those before
    ranged = cut(counted.repartitionByRange(value).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").agg(F.sum("__n").alias("__size"))
    before = sizes.select("__part", (F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).alias("__before"))
    end = F.col("__before") + F.sum("__n").over(Window.partitionBy("__part").orderBy(value))
    return ranged.join(before, "__part").withColumn("__end", end).where((F.col("__end") > wanted) & (F.col("__end") - F.col("__n") <= wanted)).select(F.col(value).alias("value"))
