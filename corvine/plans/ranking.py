"""Ranking queries over label readings (field_candidates) and the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvine.functions.text import clean
from corvine.functions.tokens import vintage, words
from corvine.operators.catalog import keep_first
from corvine.operators.ranking import TEMPERATURE, TOTAL, WEIGHTS, contributions, decide, distribution, evidence, identified, name_checks, only_value, ranked, seen_tokens, spelt_out
from corvine.operators.search import linked_tokens
from corvine.operators.verification import looked_evidence
from corvine.plans.verification import _grapes, _looked_weight, _looks, _picture_weight, _pictured
from corvine.session import cut, ship_package
from corvine.sources.tables import load


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "field_candidates").select("scan_id", "field", "pos", F.lower(clean(F.col("value"))).alias("value"), "score")


def _items(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    w = load(spark, sf_dir, "catalog_wines").where(F.col("is_active") & clean(F.col("slug")).isNotNull())
    low = lambda c: F.lower(clean(F.col(c))).alias(c)
    first = keep_first(w.withColumn("slug", clean(F.col("slug"))), ["slug"], [F.col("row_id")])
    return first.select("slug", F.regexp_replace(F.lower(clean(F.col("name"))), r",? *\d{4}$", "").alias("name"), low("winery"), low("region"), low("category"), vintage(F.col("name")).alias("year"), *more)


def softmax_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution(_read(spark, sf_dir), ["scan_id", "field"])


def single_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return only_value(_read(spark, sf_dir), ["scan_id", "field"])


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Shares and items are read several times: written once."""
    shares = cut(distribution(_read(spark, sf_dir).where("field in ('name', 'winery', 'region', 'category')"), ["scan_id", "field"]))
    return shares, cut(_items(spark, sf_dir))


def _evidence(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return evidence(*_sides(spark, sf_dir), "scan_id", "slug", **options)


def evidence_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir)


def _verified(spark: SparkSession, sf_dir: str, *more: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """What was read once, and ``more`` facts of scans, go along with the proposals: the scored items are not joined again."""
    value = lambda f: F.when(F.col("field") == f, F.col("value"))
    once = lambda f: F.when(F.min(value(f)) == F.max(value(f)), F.min(value(f))).alias(f"read_{f}")
    facts = _read(spark, sf_dir).where("field in ('category', 'year') and value is not null").groupBy("scan_id").agg(once("category"), once("year"))
    for other in more:
        facts = facts.join(other, "scan_id", "full")
    scored = _evidence(spark, sf_dir, facts=facts, keep=("winery", "name", "category", "year", "read_category", "read_year", *keep))
    kind = F.when(F.col("read_category") != F.col("category"), "category").when(F.col("read_year") != F.col("year").cast("string"), "year")
    return scored.select("scan_id", "slug", "winery", "name", "evidence", kind.alias("kind"), *keep)


def verify_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each scored item with the first contradiction to what the scan read once: category, then year."""
    return _verified(spark, sf_dir)


def rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five of each scan, contradicted items last."""
    return ranked(verify_precedence(spark, sf_dir), "scan_id", "slug", F.col("kind").isNotNull(), 5).select("scan_id", "slug", "evidence", "kind", "rank")


def rank_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(rank_order(spark, sf_dir), "scan_id", "slug")


def shortlist_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three of each scan and every item with the name that was read best."""
    best = keep_first(_read(spark, sf_dir).where("field = 'name' and value is not null and score is not null"), ["scan_id"], [F.col("score").desc(), F.col("value")])
    best = cut(best.select("scan_id", F.col("value").alias("best_name")))
    is_best = F.coalesce(F.col("name") == F.col("best_name"), F.lit(False)).alias("is_best")
    shares, items = _sides(spark, sf_dir)
    # those with the best name are many and all taken, whatever their evidence; only the others are taken from the first three
    three = evidence(shares, items, "scan_id", "slug", facts=best, keep=(is_best,), first=3)
    top = cut(ranked(three.select("scan_id", "slug", "evidence", "is_best"), "scan_id", "slug", F.lit(False), 3).where("not is_best").select("scan_id", "slug"))
    wineries = shares.where("field = 'winery'").select("scan_id", F.col("value").alias("winery"))
    read = best.withColumnRenamed("best_name", "name").join(wineries, "scan_id")
    return read.join(items.select("slug", "name", "winery"), ["name", "winery"]).select("scan_id", "slug").unionByName(top)


def recommend_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first 30 items of each scan those that share winery or name with its first, without it, the first three."""
    pool = ranked(verify_precedence(spark, sf_dir).where("evidence > 0"), "scan_id", "slug", F.lit(False), 30)
    head = Window.partitionBy("scan_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    related = pool.withColumn("w", F.first("winery").over(head)).withColumn("n", F.first("name").over(head)).where("rank > 1").where((F.col("winery") == F.col("w")) | (F.col("name") == F.col("n")))
    same = F.concat_ws(",", F.when(F.col("winery") == F.col("w"), "winery"), F.when(F.col("name") == F.col("n"), "name"))
    return ranked(related.drop("rank"), "scan_id", "slug", F.lit(False), 3).select("scan_id", "slug", "evidence", same.alias("shared_fields"), "rank")


def score_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the evidence each field's best reading makes up."""
    weight = F.lit(0.0)
    for field, w in WEIGHTS.items():
        weight = F.when(F.col("field") == field, w).otherwise(weight)
    best = softmax_field(spark, sf_dir).groupBy("scan_id", "field").agg(F.max("share").alias("share"))
    return contributions(best, ["scan_id"], weight * F.col("share")).select("scan_id", "field", "part")


def debug_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best readings of each scan and field in one line."""
    c = _read(spark, sf_dir).where("value is not null and score is not null").groupBy("scan_id", "field", "value").agg(F.max("score").alias("evidence"))
    ten = ranked(c.withColumn("k", F.concat_ws("|", "scan_id", "field")), "k", "value", F.lit(False), 10)
    return ten.groupBy("scan_id", "field").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]), " > ").alias("trace"))


#: Least score of the readings that stand for the words of a label.
LEAST_SCORE = 0.3


def _label(spark: SparkSession, sf_dir: str, scans: DataFrame, **options) -> DataFrame:
    """scan_id, query: the distinct words read from the labels of some scans, with a score of ``LEAST_SCORE`` or more."""
    read = _read(spark, sf_dir).where(F.col("field").isin("name", "winery", "grape_varieties") & (F.col("score") >= LEAST_SCORE)).join(scans, "scan_id", "left_semi")
    return read.select("scan_id", F.explode(words(F.col("value"), **options)).alias("query")).distinct()


def _seen(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The five best items of each scan with the number of their names, their share of the name, the weight of their picture and that of all pictures of their look; the words of these names, and whether a reading of the scan shows them."""
    ship_package(spark)
    shares = cut(distribution(_read(spark, sf_dir).where(F.col("field").isin(*WEIGHTS)), ["scan_id", "field"]))
    items = _pictured(_items(spark, sf_dir, _grapes()).withColumn("year", F.col("year").cast("string"))).withColumn("exp", _picture_weight())
    # a number stands for the names of an item wherever they would be shuffled
    items = cut(items.withColumn("text", F.concat_ws(" ", "name", "winery")))
    texts = cut(items.where("name is not null and winery is not null").select("text").distinct().withColumn("named", F.monotonically_increasing_id()))
    numbered = cut(items.join(texts, "text", "left").drop("text"))
    # looks without pictures show nothing
    whole = numbered.where("exp is not null").groupBy(F.col("winery").alias("look_winery"), F.col("year").alias("look_year")).agg(F.sum("exp").alias("whole"))
    looks = cut(_looks(spark, sf_dir).join(whole, ["look_winery", "look_year"]))
    # used several times below: written once
    best = looked_evidence(shares, looks, numbered, "scan_id", "slug", keep=("named", _looked_weight(), "whole"), first=5)
    five = cut(ranked(best, "scan_id", "slug", F.lit(False), 5).select("scan_id", "slug", "named", "name_share", "looked", "whole"))
    tokens = cut(texts.select("named", F.explode(words(F.col("text"), min_length=5)).alias("token")))
    # items of the same names show the same words; names without long words have none to show
    names = five.groupBy("scan_id", "named").agg(F.count("*").alias("n")).join(tokens, "named", "left")
    label = cut(_label(spark, sf_dir, five.select("scan_id").distinct(), min_length=5))
    links = linked_tokens(names.where("token is not null").select("token").distinct(), label.select(F.col("query").alias("token")).distinct())
    return five, seen_tokens(names, label, cut(links), "scan_id", "named", ("n",))


def label_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortlisted items whose name the label shows in full, those it contradicts, and those it identifies.

    They are the first five by the evidence of all seven fields. The share of the pictures is that among items whose name the label does not contradict; a contradicted item has none.
    """
    five, seen = _seen(spark, sf_dir)
    checks = five.join(name_checks(cut(seen), "scan_id", "named", "n"), ["scan_id", "named"])
    is_against = F.col("n_against") > 0
    rejected = F.sum(F.when(is_against, F.col("looked"))).over(Window.partitionBy("scan_id"))
    visual = F.when(~is_against, F.round(F.col("looked") / (F.col("whole") - F.coalesce(rejected, F.lit(0.0))), 6))
    return identified(checks.withColumn("visual", visual)).select("scan_id", "slug", "is_fully_read", "n_against", "is_identified")


def grape_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortlisted items that carry one of the grapes the label spells out (or where it spells out none)."""
    w = load(spark, sf_dir, "catalog_wines").where("slug is not null").groupBy(clean(F.col("slug")).alias("slug")).agg(F.min_by(F.struct("name", "grape_varieties"), "row_id").alias("f"))
    own = w.select("slug", words(F.concat_ws(" ", "f.name", "f.grape_varieties")).alias("own"))
    five = cut(ranked(verify_precedence(spark, sf_dir), "scan_id", "slug", F.lit(False), 5).select("scan_id", "slug"))
    scans = five.select("scan_id").distinct()
    read = _read(spark, sf_dir).where("field = 'grape_varieties' and value is not null").join(scans, "scan_id", "left_semi")
    label = _label(spark, sf_dir, scans).withColumnRenamed("query", "word")
    spelt = spelt_out(read.select("scan_id", "value", words(F.col("value")).alias("needed")), label, "scan_id", "value")
    carries = F.when(F.col("needed").isNotNull(), F.size(F.array_except("needed", "own")) == 0)
    joined = five.join(own, "slug").join(spelt, "scan_id", "left")
    return joined.groupBy("scan_id", "slug").agg(F.coalesce(F.bool_or(carries), F.lit(True)).alias("fits"))


QUERIES = {f.__name__: f for f in (softmax_field, single_readings, evidence_fusion, verify_precedence, rank_order, rank_decide, shortlist_union, recommend_related, score_parts, debug_trace, label_checks, grape_checks)}

_B = "chr(32) || chr(9) || chr(10) || chr(13) || chr(160)"
_low = lambda c: f"nullif(lower(trim({c}, {_B})), '')"
_R = rf"""WITH c AS (SELECT scan_id, field, pos, {_low('value')} AS value, score FROM field_candidates
), best AS (SELECT scan_id, field, value, max(score) AS score FROM c WHERE value IS NOT NULL AND score IS NOT NULL GROUP BY ALL
), e AS (SELECT *, exp((score - max(score) OVER (PARTITION BY scan_id, field)) / {TEMPERATURE}) AS e FROM best
), sh AS (SELECT scan_id, field, value, round(e / sum(e) OVER (PARTITION BY scan_id, field), 6) AS share FROM e
), one AS (SELECT scan_id, field, min(value) AS value FROM c WHERE value IS NOT NULL GROUP BY ALL HAVING min(value) = max(value)
), w0 AS (SELECT *, nullif(trim(slug, {_B}), '') AS s FROM catalog_wines WHERE is_active QUALIFY row_number() OVER (PARTITION BY s ORDER BY row_id) = 1
), w AS (SELECT s AS slug, regexp_replace({_low('name')}, ',? *\d{{4}}$', '') AS name, {_low('winery')} AS winery, {_low('region')} AS region, {_low('category')} AS category,
   list_distinct(regexp_extract_all(' ' || name || ' ', '[^\d./-](19[5-9]\d|20[0-2]\d)(?:[^\d./-]|[./-][^\d])', 1)) AS ys FROM w0 WHERE s IS NOT NULL
), ev AS (SELECT n.scan_id, w.slug, w.name, w.winery, w.category, CASE WHEN len(ys) = 1 THEN ys[1] END AS year, round(({WEIGHTS['winery']} * a.share + {WEIGHTS['name']} * n.share + {WEIGHTS['region']} * coalesce(r.share, 0) + {WEIGHTS['category']} * coalesce(g.share, 0)) / {TOTAL}, 4) AS evidence, n.share > 0 AS is_named
   FROM w JOIN sh n ON n.field = 'name' AND n.value = w.name JOIN sh a ON a.field = 'winery' AND a.value = w.winery AND a.scan_id = n.scan_id
   LEFT JOIN sh r ON r.field = 'region' AND r.value = w.region AND r.scan_id = n.scan_id LEFT JOIN sh g ON g.field = 'category' AND g.value = w.category AND g.scan_id = n.scan_id
), vp AS (SELECT ev.scan_id, slug, winery, name, evidence, CASE WHEN oc.value <> category THEN 'category' WHEN oy.value <> year THEN 'year' END AS kind FROM ev LEFT JOIN one oc ON oc.scan_id = ev.scan_id AND oc.field = 'category' LEFT JOIN one oy ON oy.scan_id = ev.scan_id AND oy.field = 'year'
), ro AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY kind IS NOT NULL, evidence DESC, slug) AS rank FROM vp QUALIFY rank <= 5
), plain AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY evidence DESC, slug) AS rank FROM vp)
"""  # fmt: skip
_WEIGHT = "CASE field " + " ".join(f"WHEN '{f}' THEN {w}" for f, w in WEIGHTS.items()) + " ELSE 0 END"
ORACLES = {
    "softmax_field": _R + "SELECT * FROM sh",
    "single_readings": _R + "SELECT * FROM one",
    "evidence_fusion": _R + "SELECT scan_id, slug, evidence, is_named FROM ev",
    "verify_precedence": _R + "SELECT * FROM vp",
    "rank_order": _R + "SELECT scan_id, slug, evidence, kind, rank FROM ro",
    "rank_decide": _R + f", d AS (SELECT scan_id, coalesce(arg_min(slug, rank) FILTER (kind IS NULL), arg_min(slug, rank)) AS winner, coalesce(max(evidence) FILTER (kind IS NULL), max(evidence)) AS score, count(*) FILTER (kind IS NULL) AS nf, list_sort(list(evidence) FILTER (kind IS NULL), 'DESC') AS l FROM ro GROUP BY 1) SELECT scan_id, winner, score, round(score - coalesce(l[2], 0), 4) AS margin, CASE WHEN nf > 0 AND round(score - coalesce(l[2], 0), 4) >= 0.03 THEN 'matched' ELSE 'not_found' END AS status FROM d",
    "shortlist_union": _R + "SELECT scan_id, slug FROM plain WHERE rank <= 3 UNION SELECT vp.scan_id, slug FROM vp JOIN (SELECT scan_id, value FROM c WHERE field = 'name' AND value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY score DESC NULLS LAST, value) = 1) t ON t.scan_id = vp.scan_id AND t.value = vp.name",
    "recommend_related": _R + ", pool AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY evidence DESC, slug) AS rk FROM vp WHERE evidence > 0 QUALIFY rk <= 30), rel AS (SELECT p.scan_id, p.slug, p.evidence, concat_ws(',', CASE WHEN p.winery = h.winery THEN 'winery' END, CASE WHEN p.name = h.name THEN 'name' END) AS shared_fields FROM pool p JOIN pool h ON h.scan_id = p.scan_id AND h.rk = 1 WHERE p.rk > 1 AND (p.winery = h.winery OR p.name = h.name)) SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY evidence DESC, slug) AS rank FROM rel QUALIFY rank <= 3",
    "score_parts": _R + f", b AS (SELECT scan_id, field, max(share) AS share FROM sh GROUP BY ALL), a AS (SELECT scan_id, field, {_WEIGHT} * share AS a FROM b) SELECT scan_id, field, round(a / sum(a) OVER (PARTITION BY scan_id), 6) AS part FROM a WHERE a > 0",
    "debug_trace": _R + ", t AS (SELECT scan_id, field, value, row_number() OVER (PARTITION BY scan_id, field ORDER BY score DESC, value) AS rank FROM best QUALIFY rank <= 10) SELECT scan_id, field, string_agg(value, ' > ' ORDER BY rank) AS trace FROM t GROUP BY ALL",
}
