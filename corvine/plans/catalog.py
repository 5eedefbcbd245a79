"""Catalogue queries: import, browse, filters, summaries, links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions.text import clean, media_stem, picture_key, slug_key
from corvine.operators.catalog import all_of, contains_any_case, duplicate_rows, first_attempt, first_wins, insert_ignore, keep_first, latest, page, sample_by_hash, shared, text_or, upsert
from corvine.operators.linkage import CLEAR_MATCH, GENERIC, PAIR_MATCH, displace, link, mark_suspicious
from corvine.plans.search import _latin
from corvine.session import cut, ship_package
from corvine.sources.tables import load

_TEXTS = ["name", "category", "color", "region", "winery"]


def _wines(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = load(spark, sf_dir, "catalog_wines")
    return w.select("row_id", "feed", "is_active", "loaded_at", "source_row_no", clean(F.col("slug")).alias("slug"), *(clean(F.col(c)).alias(c) for c in [*_TEXTS, "description", "grape_varieties", "source_image_filename"]))


def catalog_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_wins(_wines(spark, sf_dir), "slug", "row_id", _TEXTS)


def catalog_clean_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.filter(F.transform(F.split("grape_varieties", ","), lambda x: F.trim(x)), lambda x: x != "")
    return _wines(spark, sf_dir).select("row_id", F.posexplode(parts).alias("pos", "grape"))


def missing_key_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wines(spark, sf_dir).where(F.col("slug").isNull()).select(F.lit("missing_slug").alias("kind"), "row_id", "feed")


def duplicate_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_rows(_wines(spark, sf_dir), "slug", "row_id").select(F.lit("duplicate_slug").alias("kind"), "slug", "row_id", "first_row", "n_rows")


def wines_upsert_deactivate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run 1 holds the rows of the trusted feeds, run 2 those of all feeds but the producer."""
    w = _wines(spark, sf_dir).where(F.col("slug").isNotNull())
    snap = lambda rows: keep_first(rows, ["slug"], [F.col("row_id")]).select("slug", *_TEXTS)
    old = snap(w.where(F.col("feed").isin("producer", "distributor"))).select("*", F.lit(1).alias("first_seen"), F.lit(1).alias("updated"), F.lit(True).alias("is_active"))
    return upsert(old, snap(w.where(F.col("feed") != "producer")), "slug", _TEXTS, 2)


def _primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One picture a name key: alive, portrait first, then largest, then last path."""
    i = load(spark, sf_dir, "source_images").withColumn("key", picture_key(F.col("filename"))).where(F.col("key").isNotNull() & ~F.col("is_deleted"))
    return i.groupBy("key").agg(
        F.max_by(F.struct("strapi_path", "image_sha256", "size_bytes"), F.struct((F.col("height") > F.col("width")).alias("portrait"), "size_bytes", "strapi_path")).alias("p")
    ).select("key", "p.*")


def active_with_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _wines(spark, sf_dir).where("is_active").withColumn("key", picture_key(F.col("source_image_filename")))
    return w.join(_primary(spark, sf_dir), "key", "left").select("row_id", text_or(F.col("name"), "без названия").alias("name"), F.col("image_sha256").isNotNull().alias("has_image"))


def references_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _wines(spark, sf_dir).withColumn("key", picture_key(F.col("source_image_filename")))
    f = load(spark, sf_dir, "feeds")
    return w.where("is_active").join(_primary(spark, sf_dir), "key").join(f, "feed").select("row_id", "image_sha256", "trust")


def primary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The picture of every wine that an override names, by slug."""
    o = load(spark, sf_dir, "image_overrides").select("override_id", slug_key(F.col("slug")).alias("k")).where("k is not null")
    w = _wines(spark, sf_dir).where("is_active").select(slug_key(F.col("slug")).alias("k"), "row_id", picture_key(F.col("source_image_filename")).alias("key")).where("k is not null and key is not null")
    return o.join(w, "k").join(_primary(spark, sf_dir), "key").select("override_id", "row_id", "image_sha256")


def orphan_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _wines(spark, sf_dir).select(picture_key(F.col("source_image_filename")).alias("key"))
    return load(spark, sf_dir, "source_images").withColumn("key", picture_key(F.col("filename"))).join(w, "key", "left_anti").select("strapi_path")


def best_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _primary(spark, sf_dir)


_ADMIN = "concat_ws(' ', name, winery, slug, region, grape_varieties)"


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "labeled_real_photos").select(slug_key(F.col("expected_slug")).alias("k")).where("k is not null").distinct()


def admin_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 2 of the rows that match a search, each with an existence flag, and the total."""
    w = _wines(spark, sf_dir).withColumn("k", slug_key(F.col("slug")))
    # the right side has each key once, so the join only adds the flag
    flagged = w.join(_indexed(spark, sf_dir).withColumn("__there", F.lit(True)), "k", "left").withColumn("is_indexed", F.coalesce("__there", F.lit(False)))
    hits = flagged.where(contains_any_case(F.expr(_ADMIN), "сад"))
    order = [F.col("winery").asc_nulls_last(), F.col("name").asc_nulls_last(), F.col("slug").asc_nulls_last(), F.col("row_id")]
    return page(hits, order, 2, 24).select("row_id", "winery", "name", "slug", "is_indexed", "total")


def admin_status_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _wines(spark, sf_dir).where("is_active").select("row_id", slug_key(F.col("slug")).alias("k"), picture_key(F.col("source_image_filename")).alias("key"))
    flagged = (
        w.join(_primary(spark, sf_dir).select("key", F.lit(True).alias("has")), "key", "left")
        .join(_indexed(spark, sf_dir).withColumn("indexed", F.lit(True)), "k", "left")
        .select(F.coalesce("has", F.lit(False)).alias("has"), F.coalesce("indexed", F.lit(False)).alias("indexed"))
    )
    rules = {"all": F.lit(True), "with": F.col("has"), "without": ~F.col("has"), "indexed": F.col("indexed"), "not_indexed": ~F.col("indexed"), "suspicious": F.col("indexed") & ~F.col("has")}
    one = flagged.agg(*(F.count_if(c).alias(k) for k, c in rules.items()))
    return one.select(F.expr("stack(6, " + ", ".join(f"'{k}', `{k}`" for k in rules) + ") AS (status, n)"))


def kpi_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, i = _wines(spark, sf_dir), load(spark, sf_dir, "source_images")
    keys = w.select(picture_key(F.col("source_image_filename")).alias("key")).where("key is not null")
    parts = [
        w.agg(F.count("*").alias("n_rows"), F.count_distinct("slug").alias("n_slugs"), F.count_if("is_active").alias("n_active"), F.count_distinct("winery").alias("n_wineries")),
        i.agg(F.count("*").alias("n_files"), F.count_distinct("image_sha256").alias("n_images")),
        i.withColumn("key", picture_key(F.col("filename"))).join(keys, "key", "left_anti").agg(F.count("*").alias("n_orphans")),
        w.where("feed is not null").groupBy("feed").agg(F.max("row_id").alias("m")).agg(F.max_by("feed", "m").alias("last_feed")),
    ]
    # each side is one row
    return reduce(lambda a, b: a.join(F.broadcast(b), F.lit(True)), parts)


def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(load(spark, sf_dir, "events").where(F.col("value") > 0), "user_id", "event_id", ["event_type"])


def sommelier_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _wines(spark, sf_dir).where("is_active")
    hits = w.where(all_of([contains_any_case(F.col(c), v) for c, v in (("color", "красн"), ("region", None), ("grape_varieties", "саперави"), ("category", "вино"))]))
    order = [F.when(F.col("description").isNull(), 1).otherwise(0), *(F.col(c).asc_nulls_last() for c in ("winery", "name", "slug")), F.col("row_id")]
    return hits.orderBy(*order).limit(8).select("row_id", "winery", "name", "slug")


def relaxed_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _wines(spark, sf_dir).where("is_active")
    base = all_of([contains_any_case(F.col("color"), "бел")])
    strict = w.where(base & contains_any_case(F.col("description"), "не бывает такого вина"))
    return first_attempt([strict.select("row_id", "slug"), w.where(base).select("row_id", "slug")])


def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id").subtract(load(spark, sf_dir, "doc_labels").select("doc_id"))


def embeddings_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings").select("vec_id", "label")
    more = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.lit(-1).alias("label"))
    return insert_ignore(e, more, ["vec_id"])


def shared_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that more than one source holds."""
    return shared(load(spark, sf_dir, "documents").where("source is not null"), "text", "source")


def archive_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of every uploaded file by its path, counted."""
    path = F.lower("strapi_path")
    ext = F.regexp_extract(path, r"\.([a-z0-9]+)$", 1)
    kind = (
        F.when(~path.startswith("uploads/"), "outside_uploads")
        .when(path.rlike(r"/(thumbnail|small|medium|large)_"), "derivative")
        .when(~ext.isin("jpg", "jpeg", "png", "webp"), "unsupported_extension")
        .otherwise("original")
    )
    return load(spark, sf_dir, "source_images").groupBy(kind.alias("kind"), ext.alias("ext")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


def split_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "photo_search_pilot").select(F.lower(clean(F.col("capture_group"))).alias("capture_group"), F.lower(clean(F.col("split"))).alias("split"))
    return p.where("capture_group is not null").groupBy("capture_group").agg(F.count_distinct("split").alias("n_splits"), F.count("*").alias("n_rows")).where("n_splits > 1")


def sample_deterministic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_by_hash(_wines(spark, sf_dir).select("row_id", "slug"), "row_id", 100)


def _digest() -> Column:
    return F.sha2(F.concat_ws("|", "slug", "name", "winery", "region"), 256).alias("digest")


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of each row's parts joined by a bar."""
    return _wines(spark, sf_dir).select("row_id", _digest())


def fingerprint_by_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of every feed that does not depend on the order of its rows: count and the sum of the leading 32 bits of the row digests."""
    d = _wines(spark, sf_dir).select("feed", _digest())
    return d.groupBy("feed").agg(F.count("*").alias("n"), F.sum(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")).alias("checksum"))


def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers (here the photos of one capture group) whose every named slug exists in the catalogue."""
    p = load(spark, sf_dir, "photo_search_pilot").select(F.lower(clean(F.col("capture_group"))).alias("answer"), slug_key(F.col("expected_slug")).alias("k")).where("answer is not null and k is not null").distinct()
    known = _wines(spark, sf_dir).select(slug_key(F.col("slug")).alias("k")).where("k is not null").distinct().withColumn("known", F.lit(True))
    return p.join(known, "k", "left").groupBy("answer").agg(F.count("*").alias("n_named"), F.count_if(F.col("known").isNull()).alias("n_missing")).withColumn("is_grounded", F.col("n_missing") == 0)


def override_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last override of each slug put on its link: set replaces the picture, reject removes it, confirm keeps it."""
    o = load(spark, sf_dir, "image_overrides").select("override_id", slug_key(F.col("slug")).alias("k"), F.trim("action").alias("action"), picture_key(F.col("strapi_filename")).alias("named")).where("k is not null")
    last = o.groupBy("k").agg(F.max_by(F.struct("action", "named"), F.col("override_id")).alias("o"))
    w = _wines(spark, sf_dir).select("row_id", slug_key(F.col("slug")).alias("k"), picture_key(F.col("source_image_filename")).alias("key"))
    key = F.when(F.col("o.action") == "set", F.col("o.named")).when(F.col("o.action") == "reject", F.lit(None)).otherwise(F.col("key"))
    status = F.when(F.col("o.action") == "set", "confirmed").when(F.col("o.action") == "confirm", "confirmed").when(F.col("o.action") == "reject", "rejected").otherwise("auto")
    return w.join(last, "k", "left").select("row_id", key.alias("picture"), status.alias("review_status"))


def linkage_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picture of each row by its file name, else by its slug (the stem of a file is the slug)."""
    p = _primary(spark, sf_dir).select("key", "image_sha256")
    w = _wines(spark, sf_dir).select("row_id", picture_key(F.col("source_image_filename")).alias("by_name"), F.regexp_replace(F.lower("slug"), r"[^\p{L}\p{N}]", "").alias("by_slug"))
    joined = w.join(p.toDF("by_name", "sha_name"), "by_name", "left").join(p.toDF("by_slug", "sha_slug"), "by_slug", "left")
    return joined.select("row_id", F.coalesce("sha_name", "sha_slug").alias("image_sha256"), F.when(F.col("sha_name").isNotNull(), "exact_filename").when(F.col("sha_slug").isNotNull(), "exact_slug").alias("mapping_kind"))


def _link_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One item a slug (its first active row), and the pictures that are not deleted."""
    w = keep_first(_wines(spark, sf_dir).where("is_active and slug is not null"), ["slug"], [F.col("row_id")])
    stem = F.regexp_replace(F.coalesce("source_image_filename", F.lit("")), r"\.[^.]*$", "")
    items = w.select(F.col("slug").alias("item"), picture_key(F.col("source_image_filename")).alias("name_key"), F.regexp_replace(F.lower("slug"), r"[^\p{L}\p{N}]", "").alias("item_key"), F.concat_ws(" ", "slug", stem, "name", "winery").alias("text"))
    media = load(spark, sf_dir, "source_images").where("not is_deleted").select(F.col("strapi_path").alias("path"), "filename", F.col("image_sha256").alias("image"), picture_key(F.col("filename")).alias("key"), "width", "height", F.col("size_bytes").alias("size"))
    return items, media


def linkage_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tiers: file name, slug, similar words with each picture once; with the review mark."""
    ship_package(spark)
    return mark_suspicious(link(*_link_sides(spark, sf_dir)))


def linkage_equal_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where only equal words are similar."""
    return mark_suspicious(link(*_link_sides(spark, sf_dir), fuzzy=False))


def _displaced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items, media = _link_sides(spark, sf_dir)
    o = load(spark, sf_dir, "image_overrides").select(F.col("override_id").alias("line_no"), slug_key(F.col("slug")).alias("k"), F.trim("action").alias("action"), F.trim("strapi_filename").alias("filename"))
    known = items.select("item", slug_key(F.col("item")).alias("k")).groupBy("k").agg(F.min("item").alias("item"))
    lines = o.join(known, "k").where(F.col("action").isin("set", "reject", "confirm")).select("line_no", "item", "action", "filename")
    return displace(cut(mark_suspicious(link(items, media, fuzzy=False))), lines, media)


def override_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links after the manual corrections, which take pictures from their former owners."""
    return _displaced(spark, sf_dir)[0]


def override_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _displaced(spark, sf_dir)[1]


def media_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "source_images").select("strapi_path", media_stem(F.col("filename")).alias("stem"))


QUERIES = {f.__name__: f for f in (
    catalog_first_wins, catalog_clean_split, missing_key_issues, duplicate_issues, wines_upsert_deactivate, active_with_flag, references_join, primary_lookup, orphan_images, best_file,
    admin_browse, admin_status_filters, kpi_summary, latest_run, sommelier_filters, relaxed_fallback, missing_keys, embeddings_insert_ignore, shared_items, archive_classify, split_leak,
    sample_deterministic, fingerprint, fingerprint_by_feed, grounding, override_apply, linkage_tiers, linkage_full, linkage_equal_words, override_mappings, override_issues, media_stems,
)}

_B = "chr(32) || chr(9) || chr(10) || chr(13) || chr(160)"
_C = f"nullif(trim({{c}}, {_B}), '')"
_SLUG = f"nullif(regexp_replace(lower(trim({{c}}, {_B})), '[-_]+', '-', 'g'), '')"
_STEM = rf"regexp_replace(regexp_replace(regexp_replace(trim({{c}}, {_B}), '^.*[/\\]', ''), '\.[^.]*$', ''), '_[0-9a-fA-F]{{{{10}}}}$', '')"
_PIC = rf"CASE WHEN trim({{c}}, {_B}) <> '' THEN regexp_replace(lower({_STEM}), '[^\p{{{{L}}}}\p{{{{N}}}}]', '', 'g') END"


def _sql(pattern: str, column: str) -> str:
    return pattern.format(c=column).replace("{{", "{").replace("}}", "}")


_W = f"""WITH w AS (
  SELECT row_id, feed, is_active, loaded_at, source_row_no, {", ".join(f"{_sql(_C, c)} AS {c}" for c in ["slug", *_TEXTS, "description", "grape_varieties", "source_image_filename"])} FROM catalog_wines
), k AS (
  SELECT *, {_sql(_SLUG, "slug")} AS k, {_sql(_PIC, "source_image_filename")} AS pic FROM w
), p AS (
  SELECT {_sql(_PIC, "filename")} AS key, last(strapi_path ORDER BY coalesce(height > width, false), size_bytes, strapi_path) AS strapi_path,
    last(image_sha256 ORDER BY coalesce(height > width, false), size_bytes, strapi_path) AS image_sha256, last(size_bytes ORDER BY coalesce(height > width, false), size_bytes, strapi_path) AS size_bytes
  FROM source_images WHERE NOT is_deleted AND {_sql(_PIC, "filename")} IS NOT NULL GROUP BY 1
), idx AS (
  SELECT DISTINCT {_sql(_SLUG, "expected_slug")} AS k FROM labeled_real_photos WHERE {_sql(_SLUG, "expected_slug")} IS NOT NULL
)
"""  # fmt: skip
_FIRST = ", ".join(f"first({c} ORDER BY row_id) AS {c}" for c in _TEXTS)
_FW = _W + f", fw AS (SELECT slug, {_FIRST}, count(*) AS n_rows, max(row_id) AS last_row, count(DISTINCT to_json(struct_pack({', '.join(f'{c} := {c}' for c in _TEXTS)}))) > 1 AS payload_differs FROM w WHERE slug IS NOT NULL GROUP BY slug) "

_RECORD = lambda c: f"list_distinct(list_filter(regexp_extract_all({_latin(c)}, '[a-zа-яё0-9]+'), lambda t: length(t) >= 3 AND NOT regexp_full_match(t, '\\d+') AND t NOT IN {GENERIC}))"
#: The third tier: the sequential choice as a recursion over the open items in order, one row a step, which carries the candidates taken so far.
_LINK = _W.replace("WITH w AS", "WITH RECURSIVE w AS") + rf""", it AS (
  SELECT slug AS item, pic AS name_key, regexp_replace(lower(slug), '[^\p{{L}}\p{{N}}]', '', 'g') AS item_key, concat_ws(' ', slug, regexp_replace(coalesce(source_image_filename, ''), '\.[^.]*$', ''), name, winery) AS text FROM k WHERE is_active AND slug IS NOT NULL QUALIFY row_number() OVER (PARTITION BY slug ORDER BY row_id) = 1
), ex AS (SELECT item, text, coalesce(a.image_sha256, b.image_sha256) AS image, CASE WHEN a.key IS NOT NULL THEN a.strapi_path ELSE b.strapi_path END AS path, CASE WHEN a.key IS NOT NULL THEN 'image_filename' WHEN b.key IS NOT NULL THEN 'slug' END AS mapping_kind FROM it LEFT JOIN p a ON a.key = name_key LEFT JOIN p b ON b.key = item_key
), fr AS (SELECT image, path, array_to_string(list_sort(ws), ' ') AS cls FROM (SELECT image_sha256 AS image, strapi_path AS path, {_RECORD(_sql(_STEM, 'filename'))} AS ws FROM source_images WHERE NOT is_deleted AND image_sha256 NOT IN (SELECT image FROM ex WHERE image IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY image_sha256 ORDER BY strapi_path) = 1) WHERE len(ws) > 0
), cl AS (SELECT cls, string_split(cls, ' ') AS mw, count(*) AS room FROM fr GROUP BY 1
), op AS (SELECT item, {_RECORD('text')} AS iw FROM ex WHERE mapping_kind IS NULL
), sc AS (SELECT item, cls, room, round(0.8 * len(list_intersect(iw, mw)) / len(mw) + 0.2 * len(list_intersect(iw, mw)) / len(iw), 6) AS score FROM op JOIN cl ON list_has_any(iw, mw)
), cand AS (SELECT item, row_number() OVER (ORDER BY item) AS no, list({{'score': -score, 'cls': cls, 'room': room}} ORDER BY -score, cls) AS cs FROM sc WHERE score >= {PAIR_MATCH} GROUP BY item
), step AS (SELECT 0::BIGINT AS no, NULL::VARCHAR AS item, NULL::VARCHAR AS cls, NULL::DOUBLE AS score, []::VARCHAR[] AS taken
  UNION ALL SELECT no, item, pick.cls, -pick.score, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick.cls) END FROM (
    SELECT cand.no, cand.item, taken, list_filter(cs, lambda c: len(list_filter(taken, lambda t: t = c.cls)) < c.room)[1] AS pick FROM step JOIN cand ON cand.no = step.no + 1)
), third AS (SELECT item, cls, score, row_number() OVER (PARTITION BY cls ORDER BY item) AS place FROM step WHERE cls IS NOT NULL
), fm AS (SELECT item, image, path, mapping_kind, 1.0::DOUBLE AS mapping_score FROM ex WHERE mapping_kind IS NOT NULL
  UNION ALL SELECT item, image, path, 'fuzzy_filename', score FROM third JOIN (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY path) AS place FROM fr) USING (cls, place)
), marked AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY image) > 1 OR (mapping_kind = 'fuzzy_filename' AND mapping_score < {CLEAR_MATCH}) THEN 'suspicious' ELSE 'auto' END AS review_status FROM fm)
"""
_OVERRIDES = f""", o1 AS (SELECT item, line_no, action, filename FROM (SELECT min(item) AS item, {_sql(_SLUG, 'item')} AS ik FROM it GROUP BY 2) JOIN (SELECT override_id AS line_no, {_sql(_SLUG, 'slug')} AS ok, trim(action) AS action, trim(strapi_filename) AS filename FROM image_overrides) ON ik = ok WHERE action IN ('set', 'reject', 'confirm') QUALIFY row_number() OVER (PARTITION BY item ORDER BY line_no) = 1
), sets AS (SELECT o1.*, n, f.path, image FROM o1 LEFT JOIN (SELECT filename, count(DISTINCT image_sha256) AS n, min(strapi_path) AS path, arg_min(image_sha256, strapi_path) AS image FROM source_images WHERE NOT is_deleted GROUP BY 1) f USING (filename) WHERE action = 'set'
), good AS (SELECT *, max(line_no) OVER (PARTITION BY image) AS top FROM sets WHERE n = 1
), held AS (SELECT m.*, o1.action, t.top FROM marked m LEFT JOIN o1 USING (item) LEFT JOIN (SELECT DISTINCT image, top FROM good) t ON t.image = m.image WHERE o1.action IS DISTINCT FROM 'reject' AND m.item NOT IN (SELECT item FROM good)
), stay AS (SELECT item, image, path, mapping_kind, mapping_score, CASE WHEN action = 'confirm' THEN 'confirmed' ELSE review_status END AS review_status FROM held WHERE top IS NULL)
"""

ORACLES = {
    "catalog_first_wins": _FW + "SELECT * FROM fw",
    "duplicate_issues": _W + "SELECT 'duplicate_slug' AS kind, slug, row_id, min(row_id) OVER (PARTITION BY slug) AS first_row, count(*) OVER (PARTITION BY slug) AS n_rows FROM w WHERE slug IS NOT NULL QUALIFY n_rows > 1",
    "catalog_clean_split": _W + ", s AS (SELECT row_id, list_filter(list_transform(string_split(grape_varieties, ','), lambda x: trim(x)), lambda x: x <> '') AS g FROM w) SELECT row_id, (unnest(generate_series(1, len(g))) - 1)::INT AS pos, unnest(g) AS grape FROM s",
    "missing_key_issues": _W + "SELECT 'missing_slug' AS kind, row_id, feed FROM w WHERE slug IS NULL",
    "wines_upsert_deactivate": _W
    + f", o AS (SELECT slug, {_FIRST} FROM w WHERE slug IS NOT NULL AND feed IN ('producer', 'distributor') GROUP BY slug), n AS (SELECT slug, {_FIRST} FROM w WHERE slug IS NOT NULL AND feed <> 'producer' GROUP BY slug) "
    + "SELECT coalesce(n.slug, o.slug) AS slug, " + ", ".join(f"CASE WHEN n.slug IS NOT NULL THEN n.{c} ELSE o.{c} END AS {c}" for c in _TEXTS)
    + ", CASE WHEN o.slug IS NULL THEN 2 ELSE 1 END AS first_seen, CASE WHEN n.slug IS NOT NULL THEN 2 ELSE 1 END AS updated, n.slug IS NOT NULL AS is_active FROM o FULL JOIN n ON o.slug = n.slug",
    "active_with_flag": _W + "SELECT row_id, coalesce(name, 'без названия') AS name, p.image_sha256 IS NOT NULL AS has_image FROM k LEFT JOIN p ON p.key = k.pic WHERE is_active",
    "references_join": _W + "SELECT row_id, image_sha256, trust FROM k JOIN p ON p.key = k.pic AND k.is_active JOIN feeds USING (feed)",
    "primary_lookup": _W + f"SELECT override_id, row_id, image_sha256 FROM image_overrides o JOIN k ON k.k = {_sql(_SLUG, 'o.slug')} AND k.is_active JOIN p ON p.key = k.pic",
    "orphan_images": _W + f"SELECT strapi_path FROM source_images i WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.pic = {_sql(_PIC, 'i.filename')})",
    "best_file": _W + "SELECT * FROM p",
    "admin_browse": _W + f", h AS (SELECT *, EXISTS (SELECT 1 FROM idx WHERE idx.k = k.k) AS is_indexed FROM k WHERE {_ADMIN} ILIKE '%сад%') SELECT row_id, winery, name, slug, is_indexed, count(*) OVER () AS total FROM h ORDER BY winery NULLS LAST, name NULLS LAST, slug NULLS LAST, row_id LIMIT 24 OFFSET 24",
    "admin_status_filters": _W + ", f AS (SELECT p.key IS NOT NULL AS has, idx.k IS NOT NULL AS indexed FROM k LEFT JOIN p ON p.key = k.pic LEFT JOIN idx ON idx.k = k.k WHERE is_active) "
    + " UNION ALL ".join(f"SELECT '{s}' AS status, count(*) FILTER ({c}) AS n FROM f" for s, c in (("all", "true"), ("with", "has"), ("without", "NOT has"), ("indexed", "indexed"), ("not_indexed", "NOT indexed"), ("suspicious", "indexed AND NOT has"))),
    "kpi_summary": _W + f"SELECT (SELECT count(*) FROM w) AS n_rows, (SELECT count(DISTINCT slug) FROM w) AS n_slugs, (SELECT count(*) FROM w WHERE is_active) AS n_active, (SELECT count(DISTINCT winery) FROM w) AS n_wineries, (SELECT count(*) FROM source_images) AS n_files, (SELECT count(DISTINCT image_sha256) FROM source_images) AS n_images, (SELECT count(*) FROM source_images i WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.pic = {_sql(_PIC, 'i.filename')})) AS n_orphans, (SELECT feed FROM w WHERE feed IS NOT NULL ORDER BY row_id DESC LIMIT 1) AS last_feed",
    "latest_run": "SELECT event_type, max(event_id) AS event_id, arg_max(user_id, event_id) AS user_id FROM events WHERE value > 0 GROUP BY event_type",
    "sommelier_filters": _W + "SELECT row_id, winery, name, slug FROM w WHERE is_active AND color ILIKE '%красн%' AND grape_varieties ILIKE '%саперави%' AND category ILIKE '%вино%' ORDER BY CASE WHEN description IS NULL THEN 1 ELSE 0 END, winery NULLS LAST, name NULLS LAST, slug NULLS LAST, row_id LIMIT 8",
    "relaxed_fallback": _W + ", a AS (SELECT 1 AS attempt, row_id, slug FROM w WHERE is_active AND color ILIKE '%бел%' AND description ILIKE '%не бывает такого вина%' UNION ALL SELECT 2, row_id, slug FROM w WHERE is_active AND color ILIKE '%бел%') SELECT * FROM a WHERE attempt = (SELECT min(attempt) FROM a)",
    "missing_keys": "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM doc_labels",
    "embeddings_insert_ignore": "SELECT vec_id, label FROM embeddings UNION ALL SELECT doc_id, -1 FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "shared_items": "SELECT DISTINCT text, source, count(DISTINCT source) OVER (PARTITION BY text) AS n_owners FROM documents WHERE text IS NOT NULL AND source IS NOT NULL QUALIFY n_owners > 1",
    "archive_classify": r"SELECT CASE WHEN NOT starts_with(lower(strapi_path), 'uploads/') THEN 'outside_uploads' WHEN regexp_matches(lower(strapi_path), '/(thumbnail|small|medium|large)_') THEN 'derivative' WHEN regexp_extract(lower(strapi_path), '\.([a-z0-9]+)$', 1) NOT IN ('jpg', 'jpeg', 'png', 'webp') THEN 'unsupported_extension' ELSE 'original' END AS kind, regexp_extract(lower(strapi_path), '\.([a-z0-9]+)$', 1) AS ext, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM source_images GROUP BY ALL",
    "split_leak": f"SELECT lower({_sql(_C, 'capture_group')}) AS capture_group, count(DISTINCT lower({_sql(_C, 'split')})) AS n_splits, count(*) AS n_rows FROM photo_search_pilot WHERE {_sql(_C, 'capture_group')} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT lower({_sql(_C, 'split')})) > 1",
    "sample_deterministic": _W + "SELECT row_id, slug FROM w ORDER BY (row_id * 1103515245 + 12345) % 2147483648, row_id LIMIT 100",
    "fingerprint": _W + "SELECT row_id, sha256(concat_ws('|', slug, name, winery, region)) AS digest FROM w",
    "fingerprint_by_feed": _W + "SELECT feed, count(*) AS n, sum(('0x' || substr(sha256(concat_ws('|', slug, name, winery, region)), 1, 8))::BIGINT)::BIGINT AS checksum FROM w GROUP BY feed",
    "grounding": _W + f", a AS (SELECT DISTINCT lower({_sql(_C, 'capture_group')}) AS answer, {_sql(_SLUG, 'expected_slug')} AS k FROM photo_search_pilot) SELECT answer, count(*) AS n_named, count(*) FILTER (a.k NOT IN (SELECT k FROM k WHERE k IS NOT NULL)) AS n_missing, count(*) FILTER (a.k NOT IN (SELECT k FROM k WHERE k IS NOT NULL)) = 0 AS is_grounded FROM a WHERE answer IS NOT NULL AND k IS NOT NULL GROUP BY answer",
    "override_apply": _W + f", o AS (SELECT {_sql(_SLUG, 'slug')} AS k, arg_max(trim(action), override_id) AS action, last({_sql(_PIC, 'strapi_filename')} ORDER BY override_id) AS named FROM image_overrides WHERE {_sql(_SLUG, 'slug')} IS NOT NULL GROUP BY 1) SELECT row_id, CASE WHEN action = 'set' THEN named WHEN action = 'reject' THEN NULL ELSE pic END AS picture, CASE WHEN action IN ('set', 'confirm') THEN 'confirmed' WHEN action = 'reject' THEN 'rejected' ELSE 'auto' END AS review_status FROM k LEFT JOIN o ON o.k = k.k",
    "linkage_tiers": _W + r"SELECT row_id, coalesce(a.image_sha256, b.image_sha256) AS image_sha256, CASE WHEN a.image_sha256 IS NOT NULL THEN 'exact_filename' WHEN b.image_sha256 IS NOT NULL THEN 'exact_slug' END AS mapping_kind FROM k LEFT JOIN p a ON a.key = k.pic LEFT JOIN p b ON b.key = regexp_replace(lower(slug), '[^\p{L}\p{N}]', '', 'g')",
    "linkage_equal_words": _LINK + "SELECT item, image, path, mapping_kind, mapping_score, review_status FROM marked",
    "override_mappings": _LINK + _OVERRIDES + "SELECT item, image, path, mapping_kind, mapping_score, review_status FROM stay UNION ALL SELECT item, image, path, 'override', 1.0, 'confirmed' FROM good WHERE line_no = top",
    "override_issues": _LINK + _OVERRIDES + "SELECT 'displaced' AS kind, item, top AS line_no FROM held WHERE top IS NOT NULL UNION ALL SELECT 'displaced', item, top FROM good WHERE line_no < top UNION ALL SELECT CASE WHEN n IS NULL THEN 'unknown_file' ELSE 'ambiguous_file' END, item, line_no FROM sets WHERE n IS NULL OR n > 1 UNION ALL SELECT 'nothing_to_confirm', item, line_no FROM o1 WHERE action = 'confirm' AND item NOT IN (SELECT item FROM marked)",
    "media_stems": f"SELECT strapi_path, {_sql(_STEM, 'filename')} AS stem FROM source_images",
}
