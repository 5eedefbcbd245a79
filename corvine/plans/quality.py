"""Queries of the data-quality operators: references, packed values, rejected lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions.text import picture_key, slug_key
from corvine.operators.packed import explode_packed
from corvine.operators.references import Reference, Target, orphan_references, orphans_by_period
from corvine.operators.rejects import CATALOG, OVERRIDES, load_kind, rejected_lines
from corvine.sources.tables import load


def _links(spark: SparkSession, sf_dir: str) -> tuple[list[Reference], list[Target]]:
    wines, images, overrides, labels = (load(spark, sf_dir, t) for t in ("catalog_wines", "source_images", "image_overrides", "labeled_real_photos"))
    refs = [
        Reference("image_overrides", overrides, F.col("override_id"), F.col("recorded_at"), slug_key(F.col("slug")), "wine"),
        Reference("labeled_real_photos", labels, F.col("photo_id"), F.col("labeled_at"), slug_key(F.col("expected_slug")), "wine"),
        Reference("catalog_wines", wines, F.col("row_id"), F.col("loaded_at"), picture_key(F.col("source_image_filename")), "picture"),
    ]
    targets = [
        Target("wine", wines, slug_key(F.col("slug")), F.col("loaded_at"), F.col("is_active")),
        Target("picture", images, picture_key(F.col("filename")), F.col("uploaded_at"), ~F.col("is_deleted")),
    ]
    return refs, targets


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(*_links(spark, sf_dir))


def p1_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans_by_period(*_links(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_packed(load(spark, sf_dir, "catalog_wines"), "row_id", "grape_varieties", "grape")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected_lines(load(spark, sf_dir, "raw_lines"))


def p3_catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_kind(load(spark, sf_dir, "raw_lines"), CATALOG)


def p3_override_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_kind(load(spark, sf_dir, "raw_lines"), OVERRIDES)


QUERIES = {
    "p1_found": p1_found,
    "p1_by_period": p1_by_period,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_catalog_rows": p3_catalog_rows,
    "p3_override_rows": p3_override_rows,
}

_SLUG = r"nullif(regexp_replace(regexp_replace(lower(regexp_replace({c}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')), '[-_]+', '-', 'g'), '^$', ''), '')"
_PICTURE = (
    r"CASE WHEN regexp_replace({c}, '[\s\x{{a0}}]+', '', 'g') <> '' THEN regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace("
    r"regexp_replace({c}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g'), '^.*[/\\]', ''), '\.[^.]*$', ''), '_[0-9a-fA-F]{{10}}$', '')), '[^\p{{L}}\p{{N}}]', '', 'g') END"
)

_P1_STATES = f"""
WITH refs AS (
  SELECT 'image_overrides' AS ref_table, override_id AS ref_id, recorded_at AS t, 'wine' AS target, {_SLUG.format(c="slug")} AS k FROM image_overrides
  UNION ALL SELECT 'labeled_real_photos', photo_id, labeled_at, 'wine', {_SLUG.format(c="expected_slug")} FROM labeled_real_photos
  UNION ALL SELECT 'catalog_wines', row_id, loaded_at, 'picture', {_PICTURE.format(c="source_image_filename")} FROM catalog_wines
), targets AS (
  SELECT target, k, min(t) AS first_seen, bool_or(alive) AS any_alive FROM (
    SELECT 'wine' AS target, {_SLUG.format(c="slug")} AS k, loaded_at AS t, coalesce(is_active, true) AS alive FROM catalog_wines
    UNION ALL SELECT 'picture', {_PICTURE.format(c="filename")}, uploaded_at, coalesce(NOT is_deleted, true) FROM source_images)
  WHERE k IS NOT NULL GROUP BY ALL
), states AS (
  SELECT ref_table, strftime(r.t, '%Y-%m') AS period, ref_id,
    CASE WHEN g.k IS NULL THEN 'missing' WHEN NOT any_alive THEN 'deleted' WHEN first_seen > r.t THEN 'late' END AS state
  FROM refs r LEFT JOIN targets g ON r.target = g.target AND r.k = g.k WHERE r.k IS NOT NULL
)
"""

_ROW_CELLS = r"""
WITH lines AS (
  SELECT rec_id, file_kind, regexp_replace(coalesce(raw_line, ''), '\r?\n?$', '') AS line FROM raw_lines WHERE coalesce(line_no, 0) <> 1
), cut AS (
  SELECT rec_id, file_kind, line, regexp_extract_all(',' || line, ',("(?:[^"]|"")*"|[^",][^,]*|)', 1) AS raw,
    regexp_full_match(line, '(?s)("([^"]|"")*"|[^",][^,]*|)(,("([^"]|"")*"|[^",][^,]*|))*') AS quoting_ok FROM lines
), cells AS (
  SELECT *, list_transform(raw, lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END) AS c FROM cut
), records AS (
  SELECT *, CASE file_kind WHEN 'catalog' THEN 9 WHEN 'overrides' THEN 4 END AS width,
    trim(CASE file_kind WHEN 'catalog' THEN c[8] ELSE c[1] END, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)) AS slug,
    trim(c[2], chr(32) || chr(9) || chr(10) || chr(13) || chr(160)) AS action, trim(c[3], chr(32) || chr(9) || chr(10) || chr(13) || chr(160)) AS picture
  FROM cells WHERE NOT (quoting_ok AND len(list_filter(c, lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)) <> '')) = 0)
), judged AS (
  SELECT *, CASE WHEN NOT quoting_ok THEN 'bad_quoting' WHEN len(c) IS DISTINCT FROM width THEN 'column_count'
    WHEN NOT regexp_full_match(slug, '[a-z0-9_-]+') OR (file_kind = 'overrides' AND (action NOT IN ('set', 'reject', 'confirm') OR (action = 'set' AND picture = ''))) THEN 'invalid_value' END AS reason
  FROM records
)
"""

ORACLES = {
    "p1_found": _P1_STATES + "SELECT * FROM states WHERE state IS NOT NULL",
    "p1_by_period": _P1_STATES
    + "SELECT ref_table, period, count(*) AS n_refs, count(*) FILTER (state = 'missing') AS n_missing, count(*) FILTER (state = 'deleted') AS n_deleted, count(*) FILTER (state = 'late') AS n_late FROM states GROUP BY ALL",
    "p2_found": r"""
WITH t AS (
  SELECT row_id, trim(grape_varieties, chr(32) || chr(9) || chr(10) || chr(13)) AS s FROM catalog_wines
), boxed AS (
  SELECT row_id, regexp_matches(s, '(?s)^(\[.*\]|\{.*\})$') AS box, s FROM t WHERE s <> ''
), toks AS (
  SELECT row_id, regexp_extract_all(CASE WHEN box THEN s[2:-2] ELSE s END,
    CASE WHEN box THEN '"(?:[^"]|"")*"|[^",]+|,' ELSE '"(?:[^"]|"")*"|[,;|/+&\t\r\n]| и |(?:[^" ,;|/+&\t\r\n]| )' END) AS ts, box FROM boxed
), marked AS (
  SELECT row_id, list_transform(ts, lambda x: CASE WHEN x IN (',', ';', '|', '/', '+', '&', chr(9), chr(10), chr(13), ' и ') THEN chr(1) ELSE x END) AS ts FROM toks
), parts AS (
  SELECT row_id, string_split(array_to_string(ts, ''), chr(1)) AS ps FROM marked
), vals AS (
  SELECT row_id, list_filter(list_transform(list_transform(ps, lambda p: trim(p, chr(32) || chr(9) || chr(10) || chr(13))),
    lambda p: CASE WHEN p LIKE '"%"' THEN trim(replace(p[2:-2], '""', '"')) ELSE p END), lambda p: p <> '') AS vs FROM parts
)
SELECT row_id, unnest(generate_series(1, len(vs)))::INT AS pos, unnest(vs) AS grape FROM vals
""",
    "p3_found": _ROW_CELLS + "SELECT rec_id, reason FROM judged WHERE reason IS NOT NULL",
    "p3_catalog_rows": _ROW_CELLS
    + "SELECT rec_id, " + ", ".join(f"c[{i + 1}] AS {n}" for i, n in enumerate(CATALOG.columns)) + " FROM judged WHERE reason IS NULL AND file_kind = 'catalog'",
    "p3_override_rows": _ROW_CELLS
    + "SELECT rec_id, " + ", ".join(f"c[{i + 1}] AS {n}" for i, n in enumerate(OVERRIDES.columns)) + " FROM judged WHERE reason IS NULL AND file_kind = 'overrides'",
}
