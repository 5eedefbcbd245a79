"""Queries that go through real files: text tables, JSON lines, versions, publication, recorded runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions.text import clean
from corvine.operators.catalog import insert_ignore
from corvine.session import ensure_checkpoint_dir
from corvine.sources.files import append_version, content_key, publish, prune, read_json_lines, read_table_text, recorded_run, replace_table, write_report
from corvine.sources.tables import load


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows written as CSV and read by their headers, which are renamed."""
    path = _folder(spark, "csv")
    load(spark, sf_dir, "catalog_wines").select("row_id", "slug", "description").write.option("header", True).option("escape", '"').option("quoteAll", True).option("nullValue", "").csv(path)
    return read_table_text(spark, path, {"row_id": "row_id", "slug": "key", "description": "about"}).select(F.col("row_id").cast("long").alias("row_id"), "key", "about")


def tsv_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as tab-separated text; a blank slug is none."""
    path = _folder(spark, "tsv")
    load(spark, sf_dir, "labeled_real_photos").select("photo_id", "image_path", "expected_slug").write.option("header", True).option("sep", "\t").option("quoteAll", True).option("nullValue", "").csv(path)
    return read_table_text(spark, path, {"photo_id": "photo_id", "image_path": "image_path", "expected_slug": "expected_slug"}, "\t").select(F.col("photo_id").cast("long").alias("photo_id"), "image_path", "expected_slug")


def jsonl_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation manifest as JSON lines; entries without a path or with an unknown split are left out."""
    path = _folder(spark, "jsonl")
    pilot = load(spark, sf_dir, "photo_search_pilot").select("entry_id", "path", "split", "image_sha256")
    pilot.write.json(path)
    rows = read_json_lines(spark, path, pilot.schema)
    return rows.where(clean(F.col("path")).isNotNull() & F.col("split").isin("tuning", "holdout", "pilot"))


def version_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs appended to one table, rows of each."""
    path = _folder(spark, "bronze")
    wines = load(spark, sf_dir, "catalog_wines").select("row_id", "slug", "feed")
    append_version(wines.where("feed = 'producer'"), path, 1)
    append_version(wines, path, 2)
    return spark.read.parquet(path).groupBy(F.col("run_id").cast("int").alias("run_id")).agg(F.count("*").alias("n"), F.count_distinct("slug").alias("n_slugs"))


def refreshed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link table that is replaced as a whole by its second state."""
    path = _folder(spark, "links")
    links = load(spark, sf_dir, "catalog_wines").select("row_id", "source_image_filename").where("source_image_filename is not null")
    replace_table(links, path)
    replace_table(links.where("row_id % 2 = 0"), path)
    return spark.read.parquet(path)


def pruned_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of one archive (the first letter of the digest stands for it) after those of all others are pruned."""
    path = _folder(spark, "sources")
    rows = load(spark, sf_dir, "source_images").select("strapi_path", "image_sha256", F.substring("image_sha256", 1, 1).alias("archive"))
    publish(rows, path)
    publish(prune(spark.read.parquet(path), "archive", ["a", "b"]), path)
    return spark.read.parquet(path)


def blob_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts put under their digest if it is not there yet: one row a digest."""
    d = load(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text").withColumn("digest", content_key("text"))
    first = d.where("doc_id % 2 = 0").groupBy("digest").agg(F.length(F.min("text")).alias("size"))
    return insert_ignore(first, d.where("doc_id % 2 = 1").select("digest", F.length("text").alias("size")), ["digest"])


def recorded_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log of three runs, of which the second has the version of the first and does nothing."""
    table, log = _folder(spark, "import"), _folder(spark, "log")
    wines = load(spark, sf_dir, "catalog_wines").select("row_id", "slug")
    for run, version in ((1, "v1"), (2, "v1"), (3, "v2")):
        recorded_run(wines.where(F.col("row_id") % run == 0), table, log, run, version, announce=True)
    return spark.read.json(log).select("run", "version", "status")


def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report in one JSON file, read again."""
    path = _folder(spark, "report")
    write_report(load(spark, sf_dir, "catalog_wines").groupBy("feed").agg(F.count("*").alias("n")), path)
    return read_json_lines(spark, path, spark.createDataFrame([], "feed string, n long").schema)


QUERIES = {f.__name__: f for f in (csv_rows, tsv_labels, jsonl_manifest, version_counts, refreshed_links, pruned_sources, blob_store, recorded_imports, json_report)}

_B = "chr(32) || chr(9) || chr(10) || chr(13) || chr(160)"
_c = lambda c: f"nullif(trim({c}, {_B}), '')"
ORACLES = {
    "csv_rows": f"SELECT row_id, {_c('slug')} AS key, {_c('description')} AS about FROM catalog_wines",
    "tsv_labels": f"SELECT photo_id, {_c('image_path')} AS image_path, {_c('expected_slug')} AS expected_slug FROM labeled_real_photos",
    "jsonl_manifest": f"SELECT entry_id, path, split, image_sha256 FROM photo_search_pilot WHERE {_c('path')} IS NOT NULL AND split IN ('tuning', 'holdout', 'pilot')",
    "version_counts": "SELECT 1 AS run_id, count(*) AS n, count(DISTINCT slug) AS n_slugs FROM catalog_wines WHERE feed = 'producer' UNION ALL SELECT 2, count(*), count(DISTINCT slug) FROM catalog_wines",
    "refreshed_links": "SELECT row_id, source_image_filename FROM catalog_wines WHERE source_image_filename IS NOT NULL AND row_id % 2 = 0",
    "pruned_sources": "SELECT strapi_path, image_sha256, image_sha256[1] AS archive FROM source_images WHERE image_sha256[1] IN ('a', 'b')",
    "blob_store": "SELECT DISTINCT sha256(text) AS digest, length(text)::INT AS size FROM documents WHERE text IS NOT NULL",
    "recorded_imports": "SELECT * FROM (VALUES (1::BIGINT, 'v1', 'running'), (1, 'v1', 'succeeded'), (3, 'v2', 'running'), (3, 'v2', 'succeeded')) AS t(run, version, status)",
    "json_report": "SELECT feed, count(*) AS n FROM catalog_wines GROUP BY 1",
}
