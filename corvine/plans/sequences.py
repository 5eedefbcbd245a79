"""Queries over ordered rows, evaluation, and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions.text import slug_key
from corvine.operators.evaluation import answer_quality, hits_at, spread
from corvine.operators.sequences import alternating, anchored_limit, assign_once, changed, nearest_rank, ordered_union, within_budget
from corvine.plans.search import document_wineries
from corvine.session import ship_package
from corvine.sources.tables import load
from corvine.streaming.events import file_stream, limited, run_latest, run_once, tumbling

_HALF_DAY = 12 * 3600


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three events of a user in a window of twelve hours."""
    ship_package(spark)
    return anchored_limit(load(spark, sf_dir, "events"), "user_id", "ts", "event_id", _HALF_DAY, 3).select("event_id", "is_allowed")


def rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return run_once(limited(file_stream(spark, f"{sf_dir}/events.parquet"), "user_id", "ts", "event_id", _HALF_DAY, 3)).withColumnRenamed("row_id", "event_id")


def tumbling_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = file_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return run_latest(tumbling(events, "ts", "event_type"), ["start", "event_type"]).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def tumbling_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def session_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))
    return s.select("user_id", "first_event", "last_event", "n")


def contract_alternation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users, their events, and how many repeat the type of the one before."""
    e = load(spark, sf_dir, "events")
    flagged = e.select("user_id", changed(e, "user_id", ["ts", "event_id"], "event_type").alias("c"))
    return flagged.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(~F.col("c")).alias("n_repeats"))


def history_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three events of each user."""
    from pyspark.sql.window import Window

    e = load(spark, sf_dir, "events")
    return e.withColumn("back", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).where("back <= 3").select("user_id", "event_id", "back")


def alternation_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events kept when view and click must take turns."""
    ship_package(spark)
    return alternating(load(spark, sf_dir, "events"), "user_id", "event_id", "event_type", ("view", "click"))


def budget_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each brand bought cheapest first with a budget of 20,000."""
    ship_package(spark)
    return within_budget(load(spark, sf_dir, "part"), "p_brand", ["p_retailprice", "p_partkey"], "p_partkey", "p_retailprice", 20_000.0)


def unique_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document, in order, gets the best winery that no earlier one took, out of all that it names."""
    hits = document_wineries(spark, sf_dir, None)
    return assign_once(hits.select(F.col("query_id").alias("left"), F.col("value").alias("right"), "score"))


def group_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.round(F.avg("s_acctbal"), 4).alias("centre"), F.min_by("s_name", "s_suppkey").alias("first_name"))
    return load(spark, sf_dir, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_nationkey", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("centre", F.lit(0.0)).alias("centre"), "first_name")


def list_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as read by winery first, then by name, each once at its first place."""
    c = load(spark, sf_dir, "field_candidates").where("value is not null")
    part = lambda f: c.where(F.col("field") == f).groupBy("value").agg(F.min("candidate_id").alias("place"))
    return ordered_union([part("winery"), part("name")], "value", "place")


def ambiguous_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = load(spark, sf_dir, "source_images").withColumn("stem", F.lower(F.regexp_replace("filename", r"_[0-9a-f]{10}\.", ".")))
    return i.groupBy("stem").agg(F.count_distinct("image_sha256").alias("n_images"), F.count("*").alias("n_files")).where("n_images > 1")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pilot photos: the label is the slug, the answer what the catalogue's active rows hold for it."""
    p = load(spark, sf_dir, "photo_search_pilot").select("entry_id", F.lower(F.trim("split")).alias("split"), slug_key(F.col("expected_slug")).alias("expected"))
    known = load(spark, sf_dir, "catalog_wines").where("is_active").select(slug_key(F.col("slug")).alias("k")).where("k is not null").distinct()
    return p.join(known, F.col("expected") == F.col("k"), "left").select("entry_id", "split", "expected", F.col("k").alias("predicted"), F.pmod(F.col("entry_id") * 37, F.lit(5000)).alias("elapsed_ms"))


def eval_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_quality(_answers(spark, sf_dir), "expected", "predicted", F.col("split"))


def eval_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _answers(spark, sf_dir)
    return nearest_rank(a, "elapsed_ms", 0.95).select(F.col("value").cast("double").alias("p95_nearest"))


def eval_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "field_candidates"), "score", "field")


def hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a listed winery stands among the first ranks of a scan."""
    c = load(spark, sf_dir, "field_candidates").where("field = 'winery'")
    listed = load(spark, sf_dir, "canonical_values").where("field = 'winery'").select(F.col("canon_value").alias("value"), F.lit(True).alias("listed")).distinct()
    return hits_at(c.join(listed, "value", "left"), "scan_id", "pos", F.coalesce("listed", F.lit(False)))


def slowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).orderBy(F.desc("elapsed_ms"), "entry_id").limit(5).select("entry_id", "elapsed_ms")


QUERIES = {f.__name__: f for f in (
    rate_limit, rate_limit_stream, tumbling_stream, tumbling_batch, session_lengths, contract_alternation, history_tail, alternation_fold, budget_selection, unique_assignment, group_centres,
    list_union, ambiguous_names, eval_by_group, eval_latency, eval_spread, hit_rates, slowest,
)}

_B = "chr(32) || chr(9) || chr(10) || chr(13) || chr(160)"
_slug = lambda c: f"nullif(regexp_replace(lower(trim({c}, {_B})), '[-_]+', '-', 'g'), '')"
_A = f"""WITH known AS (SELECT DISTINCT {_slug('slug')} AS k FROM catalog_wines WHERE is_active), a AS (
  SELECT entry_id, lower(trim(split)) AS split, {_slug('expected_slug')} AS expected, k AS predicted, (entry_id * 37) % 5000 AS elapsed_ms FROM photo_search_pilot LEFT JOIN known ON k = {_slug('expected_slug')})
"""  # fmt: skip
_RATE = """WITH RECURSIVE win AS (
  SELECT user_id, min(ts) AS b FROM events WHERE ts IS NOT NULL GROUP BY 1
  UNION ALL
  SELECT w.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = w.user_id AND e.ts >= w.b + INTERVAL 12 HOUR) FROM win w WHERE EXISTS (SELECT 1 FROM events e WHERE e.user_id = w.user_id AND e.ts >= w.b + INTERVAL 12 HOUR)
), placed AS (SELECT e.event_id, e.ts, e.user_id, max(w.b) AS b FROM events e JOIN win w ON w.user_id = e.user_id AND w.b <= e.ts GROUP BY ALL)
SELECT event_id, row_number() OVER (PARTITION BY user_id, b ORDER BY ts, event_id) <= 3 AS is_allowed FROM placed"""
ORACLES = {
    "rate_limit": _RATE,
    "rate_limit_stream": _RATE,
    **dict.fromkeys(("tumbling_batch", "tumbling_stream"), "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"),
    "session_lengths": "WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events), n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(event_id) AS first_event, max(event_id) AS last_event, count(*) AS n FROM n GROUP BY user_id, k",
    "contract_alternation": "WITH f AS (SELECT user_id, coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), true) AS c FROM events) SELECT user_id, count(*) AS n, count(*) FILTER (NOT c) AS n_repeats FROM f GROUP BY 1",
    "history_tail": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events QUALIFY back <= 3",
    "group_centres": "SELECT n_nationkey, count(s_suppkey) AS n, coalesce(round(avg(s_acctbal), 4), 0.0) AS centre, arg_min(s_name, s_suppkey) AS first_name FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1",
    "list_union": "WITH l AS (SELECT value, CASE field WHEN 'winery' THEN 0 ELSE 1 END AS list, min(candidate_id) AS place FROM field_candidates WHERE value IS NOT NULL AND field IN ('winery', 'name') GROUP BY ALL) SELECT value, list, place FROM l QUALIFY row_number() OVER (PARTITION BY value ORDER BY list, place) = 1",
    "ambiguous_names": r"SELECT lower(regexp_replace(filename, '_[0-9a-f]{10}\.', '.')) AS stem, count(DISTINCT image_sha256) AS n_images, count(*) AS n_files FROM source_images GROUP BY 1 HAVING count(DISTINCT image_sha256) > 1",
    "eval_by_group": _A
    + "SELECT CASE WHEN grouping(split) = 1 THEN 'all' ELSE coalesce(split, 'none') END AS part, count(*) AS n, count(expected) AS n_known, count(predicted) AS n_answered, count(*) FILTER (expected = predicted) AS n_right, count(*) FILTER (expected IS NULL AND predicted IS NULL) AS n_right_null, "
    + "round(count(*) FILTER (expected = predicted) / nullif(count(predicted), 0), 6) AS precision, round(count(*) FILTER (expected = predicted) / nullif(count(expected), 0), 6) AS recall, "
    + "round(coalesce(2.0 * count(*) FILTER (expected = predicted) / nullif(count(predicted) + count(expected), 0), 0), 6) AS f1, round((count(*) FILTER (expected = predicted) + count(*) FILTER (expected IS NULL AND predicted IS NULL)) / count(*), 6) AS accuracy FROM a GROUP BY GROUPING SETS ((split), ())",
    "eval_latency": _A + "SELECT list_sort(list(elapsed_ms))[round_even(0.95 * (count(*) - 1), 0)::INT + 1]::DOUBLE AS p95_nearest FROM a",
    "eval_spread": "SELECT field, count(score) AS n, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.95), 6) AS p95, round(avg(score), 6) AS mean FROM field_candidates GROUP BY 1",
    "hit_rates": "WITH c AS (SELECT scan_id, min(pos) FILTER (value IN (SELECT canon_value FROM canonical_values WHERE field = 'winery')) AS f FROM field_candidates WHERE field = 'winery' GROUP BY 1) SELECT count(*) AS n, round(count(*) FILTER (f <= 1) / count(*), 6) AS hit_1, round(count(*) FILTER (f <= 5) / count(*), 6) AS hit_5, round(count(*) FILTER (f <= 10) / count(*), 6) AS hit_10 FROM c",
    "slowest": _A + "SELECT entry_id, elapsed_ms FROM a ORDER BY elapsed_ms DESC, entry_id LIMIT 5",
}
