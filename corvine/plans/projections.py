"""Projection queries: cards, positions, unpivoted values, JSON, dates, paths, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvine.functions.text import clean
from corvine.functions.tokens import card_year
from corvine.operators.catalog import text_or
from corvine.session import cut
from corvine.sources.files import tolerant_json
from corvine.sources.tables import load


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``position``, the place of each row in the whole order, from 0.

    Rows are dealt to ranges of the order; each range is numbered on its own and shifted by the
    sizes of the ranges before it, so no task sees more than its range. Rows equal in ``order`` stand in any order.
    """
    # written once: the ranges are sampled, so a second evaluation could deal the rows otherwise
    ranged = cut(df.select("*", F.struct(*order).alias("__order")).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    # one row a partition
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).select("__part", F.coalesce("__before", F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy("__part").orderBy("__order")) - 1
    return ranged.withColumn("__local", local).join(before, "__part").withColumn("position", F.col("__local") + F.col("__before")).drop("__order", "__part", "__local", "__before")


def index_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = load(spark, sf_dir, "catalog_wines").where("is_active").select(F.coalesce("slug", F.lit("")).alias("slug"), "row_id")
    return positions(w, ["slug", "row_id"]).select("row_id", "position")


def card_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a card shows: title and winery with placeholders, year, address of the picture."""
    slug = clean(F.col("slug"))
    url = F.concat(F.lit("/api/wines/"), F.replace(F.url_encode(slug), F.lit("+"), F.lit("%20")), F.lit("/image"))
    return load(spark, sf_dir, "catalog_wines").select("row_id", text_or(F.col("name"), "без названия").alias("title"), text_or(F.col("winery"), "неизвестная винодельня").alias("maker"), card_year(F.col("name")).alias("year"), url.alias("url"))


def field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field's value of each row as a row of its own, counted."""
    w = load(spark, sf_dir, "catalog_wines").select(*(clean(F.col(c)).alias(c) for c in ("name", "winery", "region", "category", "color")))
    long = w.select(F.expr("stack(5, 'name', name, 'winery', winery, 'region', region, 'category', category, 'color', color) AS (field, value)"))
    return long.where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"))


def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose payload parses and is valid; an older key name counts as well."""
    e = load(spark, sf_dir, "events").withColumn("p", tolerant_json("props", "k int, key int"))
    value = F.coalesce("p.k", "p.key")
    return e.where(value.between(0, 90)).groupBy("event_type", (F.floor(value / 10)).alias("tens")).agg(F.count("*").alias("n"))


def log_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log line of each text without the text: the first twelve digits of its digest and its length."""
    return load(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.substring(F.sha2("text", 256), 1, 12).alias("digest"), F.length("text").alias("n"))


def bottling_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates printed in each document, and how many of them exist."""
    found = F.regexp_extract_all("text", F.lit(r"(\d{1,2}\.\d{1,2}\.\d{4})"), F.lit(1))
    d = load(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("d"))
    return d.groupBy("doc_id").agg(F.count("*").alias("n"), F.count(F.try_to_timestamp("d", F.lit("d.M.yyyy"))).alias("n_valid"))


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("strapi_path")
    base = F.substring_index(path, "/", -1)
    ext = F.lower(F.regexp_extract(base, r"\.([^.]+)\z", 1))
    mime = F.when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext == "png", "image/png").when(ext == "webp", "image/webp").otherwise("application/octet-stream")
    return load(spark, sf_dir, "source_images").select("strapi_path", base.alias("base"), ext.alias("ext"), mime.alias("mime"), (F.col("height") > F.col("width")).alias("is_portrait"))


QUERIES = {f.__name__: f for f in (index_positions, card_projection, field_values, json_records, log_digests, bottling_dates, path_parts)}

_B = "chr(32) || chr(9) || chr(10) || chr(13) || chr(160)"
_c = lambda c: f"nullif(trim({c}, {_B}), '')"
ORACLES = {
    "index_positions": "SELECT row_id, row_number() OVER (ORDER BY coalesce(slug, ''), row_id) - 1 AS position FROM catalog_wines WHERE is_active",
    "card_projection": f"SELECT row_id, coalesce({_c('name')}, 'без названия') AS title, coalesce({_c('winery')}, 'неизвестная винодельня') AS maker, nullif(regexp_extract(' ' || name || ' ', '[^\\d]((?:19|20)\\d\\d)[^\\d]', 1), '')::INT AS year, '/api/wines/' || url_encode({_c('slug')}) || '/image' AS url FROM catalog_wines",
    "field_values": " UNION ALL ".join(f"SELECT '{f}' AS field, {_c(f)} AS value, count(*) AS n FROM catalog_wines WHERE {_c(f)} IS NOT NULL GROUP BY 2" for f in ("name", "winery", "region", "category", "color")),
    "json_records": "WITH e AS (SELECT event_type, coalesce((props->>'$.k')::INT, (props->>'$.key')::INT) AS v FROM events) SELECT event_type, floor(v / 10)::BIGINT AS tens, count(*) AS n FROM e WHERE v BETWEEN 0 AND 90 GROUP BY ALL",
    "log_digests": "SELECT doc_id, substr(sha256(text), 1, 12) AS digest, length(text)::INT AS n FROM documents WHERE text IS NOT NULL",
    "bottling_dates": r"WITH d AS (SELECT doc_id, unnest(regexp_extract_all(text, '(\d{1,2}\.\d{1,2}\.\d{4})', 1)) AS d FROM documents) SELECT doc_id, count(*) AS n, count(try_strptime(d, '%d.%m.%Y')) AS n_valid FROM d GROUP BY 1",
    "path_parts": r"WITH p AS (SELECT *, regexp_extract(strapi_path, '([^/]*)$', 1) AS base FROM source_images), e AS (SELECT *, lower(regexp_extract(base, '\.([^.]+)$', 1)) AS ext FROM p) SELECT strapi_path, base, ext, CASE WHEN ext IN ('jpg', 'jpeg') THEN 'image/jpeg' WHEN ext = 'png' THEN 'image/png' WHEN ext = 'webp' THEN 'image/webp' ELSE 'application/octet-stream' END AS mime, height > width AS is_portrait FROM e",
}
