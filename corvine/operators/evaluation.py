"""Quality of answers against labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def answer_quality(df: DataFrame, expected: str, predicted: str, by: Column | None = None) -> DataFrame:
    """Counts, precision, recall and F1 of answers that may abstain (null), where null is the right answer for what is not in the catalogue.

    In one pass for each value of ``by`` and, as null, for all rows.
    """
    e, p = F.col(expected), F.col(predicted)
    right = e == p
    measures = [
        F.count("*").alias("n"),
        F.count_if(e.isNotNull()).alias("n_known"),
        F.count_if(p.isNotNull()).alias("n_answered"),
        F.count_if(right).alias("n_right"),
        F.count_if(e.isNull() & p.isNull()).alias("n_right_null"),
    ]
    rows = df.withColumn("part", by.cast("string") if by is not None else F.lit(None).cast("string"))
    out = rows.groupingSets([["part"], []], "part").agg(F.grouping_id().alias("__g"), *measures) if by is not None else rows.groupBy("part").agg(F.lit(1).alias("__g"), *measures)
    precision, recall = F.try_divide(F.col("n_right"), F.col("n_answered")), F.try_divide(F.col("n_right"), F.col("n_known"))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return out.select(
        F.when(F.col("__g") == 1, "all").otherwise(F.coalesce("part", F.lit("none"))).alias("part"), "n", "n_known", "n_answered", "n_right", "n_right_null",
        F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"), F.round((F.col("n_right") + F.col("n_right_null")) / F.col("n"), 6).alias("accuracy"),
    )


def hits_at(df: DataFrame, group: str, rank: str, hit: Column, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Share of groups with a hit among the first k ranks."""
    best = df.groupBy(group).agg(F.min(F.when(hit, F.col(rank))).alias("first"))
    return best.agg(F.count("*").alias("n"), *(F.round(F.count_if(F.col("first") <= k) / F.count("*"), 6).alias(f"hit_{k}") for k in ks))


def exact_percentiles(df: DataFrame, value: str, by: list[str], shares: dict[str, float], cells: int = 4096) -> DataFrame:
    """by, n and a column for each share: the linear percentile at index share * (n - 1) of the sorted values, as exact as a sort.

    No task sees a whole group: each group's range is cut into ``cells`` equal cells, the cells
    are counted, and only the values of the cells in which a wanted rank lies are counted one by
    one. Nulls are left out; a group without values has null percentiles.
    """
    known = df.select(*by, F.col(value).cast("double").alias("__v"))
    ends = known.groupBy(*by).agg(F.count("__v").alias("n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"k.{c}")) for c in by]
    join = lambda left, right: left.alias("k").join(right.alias("e"), reduce(lambda x, y: x & y, same, F.lit(True))).drop(*(F.col(f"e.{c}") for c in by))
    step = (F.col("__high") - F.col("__low")) / cells
    cell = F.when(step > 0, F.least(F.floor((F.col("__v") - F.col("__low")) / step), F.lit(cells - 1))).otherwise(F.lit(0)).cast("int")
    placed = join(known.where(F.col("__v").isNotNull()), ends).withColumn("__cell", cell)
    counts = placed.groupBy(*by, "n", "__cell").agg(F.count("*").alias("__m"))
    # at most ``cells`` rows a group
    ordered = counts.withColumn("__before", F.sum("__m").over(Window.partitionBy(*by).orderBy("__cell")) - F.col("__m"))
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(s * (F.col("n") - 1)), F.ceil(s * (F.col("n") - 1))) for s in shares.values()))))
    wanted = ordered.withColumn("__r", F.explode(ranks)).where((F.col("__r") >= F.col("__before")) & (F.col("__r") < F.col("__before") + F.col("__m")))
    # the cells that hold a wanted rank, a few a group; values that are equal are one row
    cells_of = wanted.select(*by, "__cell", "__before").distinct()
    match = reduce(lambda x, y: x & y, [*same, F.col("k.__cell") == F.col("e.__cell")])
    inside = placed.select(*by, "__cell", "__v").alias("k").join(cells_of.alias("e"), match).select(*(F.col(f"k.{c}") for c in by), "k.__cell", "e.__before", "k.__v")
    distinct = inside.groupBy(*by, "__cell", "__before", "__v").agg(F.count("*").alias("__m"))
    last = F.col("__before") + F.sum("__m").over(Window.partitionBy(*by, "__cell").orderBy("__v"))
    runs = distinct.select(*by, "__v", (last - F.col("__m")).alias("__first"), (last - 1).alias("__last"))
    at = lambda rank: F.max(F.when((F.col("__first") <= rank) & (F.col("__last") >= rank), F.col("__v")))
    found = []
    for name, share in shares.items():
        place = share * (F.col("n") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        found.append((low + (high - low) * F.first(place - F.floor(place))).alias(name))
    return join(runs, ends.select(*by, "n")).groupBy(*by, "n").agg(*found)


def spread(df: DataFrame, value: str, by: str) -> DataFrame:
    """Values, linear percentiles and mean of each group; a group without values has none."""
    found = exact_percentiles(df, value, [by], {"p50": 0.5, "p95": 0.95}).select(F.col(by).alias("__by"), F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))
    means = df.groupBy(by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"))
    return means.join(found, F.col(by).eqNullSafe(F.col("__by")), "left").select(by, "n", "p50", "p95", "mean")
