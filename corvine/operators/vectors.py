"""Exact vector search in blocks, votes and fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors in one block; two blocks and their product fit a task whatever the size of the tables.
BLOCK = 1024


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def normalised(a: Column) -> Column:
    """Unit length; the tiny addend keeps a zero vector finite."""
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(a, lambda x: x.cast("double") / (norm + 1e-8))


def root_descriptor(a: Column) -> Column:
    """Square root of the shares of the absolute sum."""
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")))
    return F.transform(a, lambda x: F.sqrt(F.abs(x.cast("double")) / (total + 1e-7)))


def _blocks(df: DataFrame, key: str, vector: str, group: Column, name: str, rows: str) -> DataFrame:
    """g, block, rows: the vectors of each group in blocks of about ``BLOCK``; the sizes of the groups are joined on, so that no count is needed to build the plan."""
    known = df.where(F.col(vector).isNotNull()).select(group.alias("g"), F.col(key).alias("id"), F.col(vector).alias("v"))
    sizes = known.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).alias("n"))
    dealt = known.join(sizes, "g").withColumn(name, F.pmod(F.xxhash64("id"), F.col("n")))
    return dealt.groupBy("g", name).agg(F.collect_list(F.struct("id", "v")).alias(rows))


def neighbours(data: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", within: str | None = None, least: float | None = None) -> DataFrame:
    """The ``k`` rows nearest to each query by cosine (six digits, then smallest key): query_id, id, similarity, rank. A row is not its own neighbour.

    Both sides are cut into blocks of bounded size, every query block meets every data block once
    (of the same ``within``, if given), a matrix product keeps the best ``k`` of the block, and
    the best of all blocks are merged. Pairs are never listed. Zero vectors have no neighbours.
    """
    group = F.col(within).cast("string") if within else F.lit("")
    left, right = _blocks(data, key, vector, group, "b", "rows"), _blocks(queries, key, vector, group, "qb", "wanted")
    # which blocks meet is decided on their names alone (n / 1,024 rows a side); the blocks then come to each pair by its key
    names = left.select("g", "b").join(right.select("g", "qb"), "g")
    parts = max(data.sparkSession.sparkContext.defaultParallelism, int(data.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = names.join(right, ["g", "qb"]).repartition(parts, "g", "b", "qb").join(left, ["g", "b"]).select("rows", "wanted")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def unit(rows: list) -> tuple[np.ndarray, np.ndarray]:
            ids, m = np.array([r["id"] for r in rows]), np.array([r["v"] for r in rows], dtype=np.float64)
            size = np.linalg.norm(m, axis=1, keepdims=True)
            return ids[size[:, 0] > 0], (m / np.where(size > 0, size, 1))[size[:, 0] > 0]

        for batch in batches:
            for rows, wanted in zip(batch["rows"], batch["wanted"]):
                ids, m = unit(rows)
                qids, q = unit(wanted)
                if not len(ids) or not len(qids):
                    continue
                order = np.argsort(ids)
                ids, m = ids[order], m[order]
                sims = np.round(q @ m.T, 6)
                sims[qids[:, None] == ids[None, :]] = -np.inf
                top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                best = np.take_along_axis(sims, top, 1)
                found = pd.DataFrame({"query_id": np.repeat(qids, top.shape[1]), "id": ids[top].ravel(), "similarity": best.ravel()})
                found = found[np.isfinite(found["similarity"])]
                yield found if least is None else found[found["similarity"] >= least]

    near = met.mapInPandas(run, "query_id long, id long, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def owner_votes(near: DataFrame, owners: DataFrame, reach: float = 1.25) -> DataFrame:
    """query_id, owner, score, n: every owner among a query's neighbours votes once, by its nearest, with what the distance leaves of ``reach``.

    ``near``: query_id, id, similarity; ``owners``: id, owner.
    """
    distance = F.sqrt(F.greatest(2 - 2 * F.col("similarity"), F.lit(0.0)))
    best = near.join(owners, "id").groupBy("query_id", "owner").agg(F.min(distance).alias("d"), F.count("*").alias("n"))
    return best.select("query_id", "owner", F.round(F.greatest(F.lit(0.0), reach - F.col("d")), 6).alias("score"), "n")


def saturating(inliers: Column, good: Column) -> Column:
    """e / (e + 60) of e = 2 inliers + at most 40 good matches."""
    e = 2 * inliers + F.least(good, F.lit(40))
    return e / (e + 60)


def fused(left: DataFrame, right: DataFrame, keys: list[str], a: float, b: float) -> DataFrame:
    """a * left_score + b * right_score (not below 0), at most 1, four digits; a side that lacks a key counts 0."""
    score = F.least(F.lit(1.0), a * F.coalesce("left_score", F.lit(0.0)) + b * F.greatest(F.lit(0.0), F.coalesce("right_score", F.lit(0.0))))
    return left.join(right, keys, "full").select(*keys, F.round(score, 4).alias("score"))
