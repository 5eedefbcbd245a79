"""Vector queries. The queries of a search are the rows whose id is divisible by 50, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvine.operators.vectors import cosine, fused, neighbours, normalised, owner_votes, root_descriptor
from corvine.sources.tables import load


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = load(spark, sf_dir, "embeddings")
    return e, e.where(F.col("vec_id") % 50 == 0)


def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(*_vectors(spark, sf_dir), 5)


def knn_scores_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each query with the ids asked for: the three that follow it."""
    e, q = _vectors(spark, sf_dir)
    asked = q.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 3)).alias("vec_id"))
    return asked.join(e, "vec_id").select("query_id", F.col("vec_id").alias("id"), F.round(cosine(F.col("q"), F.col("embedding")), 6).alias("similarity"))


def audit_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other vector of the same label, if near enough."""
    e, _ = _vectors(spark, sf_dir)
    return neighbours(e, e, 1, within="label", least=0.1).select("query_id", F.col("id").alias("peer_id"), "similarity")


def audit_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best reference of each query row; of several that choose the same label, the nearest proposal."""
    e, q = _vectors(spark, sf_dir)
    near = neighbours(e.where(F.col("vec_id") % 50 != 0), q, 1).join(e.select(F.col("vec_id").alias("id"), "label"), "id")
    return near.groupBy("label").agg(F.min_by(F.struct("query_id", "id", "similarity"), F.struct(-F.col("similarity"), F.col("query_id"))).alias("b")).select("label", "b.*")


def _near8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(*_vectors(spark, sf_dir), 8)


def sift_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = _vectors(spark, sf_dir)
    return owner_votes(_near8(spark, sf_dir), e.select(F.col("vec_id").alias("id"), F.col("label").alias("owner")))


def photo_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of all query vectors of a photo (two of them stand for one) added up, best 24 owners of each photo."""
    e, _ = _vectors(spark, sf_dir)
    votes = owner_votes(_near8(spark, sf_dir), e.select(F.col("vec_id").alias("id"), F.col("label").alias("owner")))
    total = votes.groupBy(F.floor(F.col("query_id") / 100).alias("photo"), "owner").agg(F.round(F.sum("score"), 5).alias("votes"), F.count("*").alias("n_vectors"))
    order = Window.partitionBy("photo").orderBy(F.desc("votes"), "owner")
    return total.withColumn("rank", F.row_number().over(order)).where("rank <= 24")


def lowe_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries whose nearest distance is below 0.99 of the second."""
    near = neighbours(*_vectors(spark, sf_dir), 2).withColumn("d", F.sqrt(2 - 2 * F.col("similarity")))
    two = near.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("d"))).alias("d1"), F.max(F.when(F.col("rank") == 2, F.col("d"))).alias("d2"))
    return two.select("query_id", F.round(F.col("d1") / F.col("d2"), 4).alias("ratio"), (F.col("d1") < 0.99 * F.col("d2")).alias("is_good"))


def visual_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best cosine of each label fused with its votes."""
    e, _ = _vectors(spark, sf_dir)
    by_cosine = knn_exact(spark, sf_dir).join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("owner")), "id").groupBy("query_id", "owner").agg(F.max("similarity").alias("right_score"))
    votes = sift_votes(spark, sf_dir).select("query_id", "owner", F.col("score").alias("left_score"))
    return fused(votes, by_cosine, ["query_id", "owner"], 0.45, 0.55)


def status_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """matched, uncertain or not_found by the best score and its margin over the second."""
    s = visual_fusion(spark, sf_dir).groupBy("query_id").agg(F.max("score").alias("top"), F.slice(F.array_sort(F.collect_list(-F.col("score"))), 2, 1).alias("second"))
    margin = F.round(F.col("top") + F.coalesce(F.get("second", F.lit(0)), F.lit(0.0)), 4)
    return s.select("query_id", "top", margin.alias("margin")).withColumn("status", F.when((F.col("top") >= 0.3) & (F.col("margin") >= 0.015), "matched").when(F.col("top") >= 0.12, "uncertain").otherwise("not_found"))


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = _vectors(spark, sf_dir)
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 5)
    return e.select("vec_id", total(normalised(F.col("embedding"))).alias("sum_unit"), total(root_descriptor(F.col("embedding"))).alias("sum_root"))


QUERIES = {f.__name__: f for f in (knn_exact, knn_scores_for, audit_peers, audit_orphans, sift_votes, photo_votes, lowe_ratio, visual_fusion, status_thresholds, vector_norms)}

_PAIRS = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS id, d.label, q.label AS q_label, round(list_cosine_similarity(q.v, d.v), 6) AS similarity FROM e q, e d WHERE q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s)
, votes AS (SELECT query_id, label AS owner, round(greatest(0, 1.25 - min(sqrt(greatest(2 - 2 * similarity, 0)))), 6) AS score, count(*) AS n FROM r WHERE rank <= 8 GROUP BY 1, 2)
, fus AS (SELECT query_id, owner, round(least(1.0, 0.45 * coalesce(v.score, 0) + 0.55 * greatest(0, coalesce(c.s, 0))), 4) AS score FROM votes v FULL JOIN (SELECT query_id, label AS owner, max(similarity) AS s FROM r WHERE rank <= 5 GROUP BY 1, 2) c USING (query_id, owner))
"""
ORACLES = {
    "knn_exact": _PAIRS + "SELECT query_id, id, similarity, rank FROM r WHERE rank <= 5",
    "knn_scores_for": _PAIRS + "SELECT query_id, id, similarity FROM s WHERE id BETWEEN query_id + 1 AND query_id + 3",
    "audit_peers": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), s AS (SELECT q.vec_id AS query_id, d.vec_id AS peer_id, round(list_cosine_similarity(q.v, d.v), 6) AS similarity FROM e q JOIN e d ON q.label = d.label AND q.vec_id <> d.vec_id) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, peer_id) = 1 AND similarity >= 0.1",
    "audit_orphans": _PAIRS + ", b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rn FROM s WHERE id % 50 <> 0) SELECT label, query_id, id, similarity FROM b WHERE rn = 1 QUALIFY row_number() OVER (PARTITION BY label ORDER BY similarity DESC, query_id) = 1",
    "sift_votes": _PAIRS + "SELECT * FROM votes",
    "photo_votes": _PAIRS + "SELECT query_id // 100 AS photo, owner, round(sum(score), 5) AS votes, count(*) AS n_vectors, row_number() OVER (PARTITION BY query_id // 100 ORDER BY round(sum(score), 5) DESC, owner) AS rank FROM votes GROUP BY 1, 2 QUALIFY rank <= 24",
    "lowe_ratio": _PAIRS + ", t AS (SELECT query_id, max(sqrt(2 - 2 * similarity)) FILTER (rank = 1) AS d1, max(sqrt(2 - 2 * similarity)) FILTER (rank = 2) AS d2 FROM r GROUP BY 1) SELECT query_id, round(d1 / d2, 4) AS ratio, d1 < 0.99 * d2 AS is_good FROM t",
    "visual_fusion": _PAIRS + "SELECT * FROM fus",
    "status_thresholds": _PAIRS + ", t AS (SELECT query_id, max(score) AS top, list_sort(list(score), 'DESC')[2] AS second FROM fus GROUP BY 1) SELECT query_id, top, round(top - coalesce(second, 0), 4) AS margin, CASE WHEN top >= 0.3 AND round(top - coalesce(second, 0), 4) >= 0.015 THEN 'matched' WHEN top >= 0.12 THEN 'uncertain' ELSE 'not_found' END AS status FROM t",
    "vector_norms": "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / (sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) + 1e-8))), 5) AS sum_unit, round(list_sum(list_transform(embedding, lambda x: sqrt(abs(x::DOUBLE) / (list_sum(list_transform(embedding, lambda y: abs(y::DOUBLE))) + 1e-7)))), 5) AS sum_root FROM embeddings",
}
