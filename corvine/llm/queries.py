"""Registered queries of this package and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm.abuse import THRESHOLD
from corvine.llm.abuse_corpus import fit, rates, score_documents
from corvine.llm.canonical import map_rows
from corvine.llm.packing import pack_specs
from corvine.llm.splits import assign, leaks, related
from corvine.llm.survivors import FIELDS, Survivors
from corvine.llm.tokens import count_tokens, encode_texts
from corvine.session import cut
from corvine.sources.tables import load


def _typed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    wines = load(spark, sf_dir, "catalog_wines")
    read = load(spark, sf_dir, "field_candidates")
    typed = wines.select(
        F.lit("catalog_wines").alias("src_table"), F.col("row_id").alias("src_id"), F.expr("stack(2, 'winery', winery, 'region', region) AS (field, value)")
    )
    return typed.unionByName(
        read.where(F.col("field").isin("winery", "region")).select(F.lit("field_candidates").alias("src_table"), F.col("candidate_id").alias("src_id"), "field", "value")
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_rows(_typed_names(spark, sf_dir), load(spark, sf_dir, "canonical_values")).select("src_table", "src_id", "field", "canon_id")


def p5_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each written value without a listed entry occurs."""
    mapped = map_rows(_typed_names(spark, sf_dir), load(spark, sf_dir, "canonical_values"))
    return mapped.where(F.col("canon_id") == -1).groupBy("field", "value").agg(F.count("*").alias("n_rows"))


def _pilot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "photo_search_pilot").select("entry_id", "capture_group", "image_sha256", "split")
    return related(rows, "entry_id", ["capture_group", "image_sha256"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_pilot(spark, sf_dir), "split").select("entry_id")


def p4_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    # split_targets: one row a split, three in all
    targets = [(row.split, row.share) for row in load(spark, sf_dir, "split_targets").collect()]
    return assign(_pilot(spark, sf_dir), targets).select("entry_id", "component", "new_split")


def p4_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each new split, and how many components lie in more than one."""
    rows = cut(p4_assigned(spark, sf_dir))
    torn = rows.groupBy("component").agg(F.count_distinct("new_split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_torn"))
    # one row on the right
    return rows.groupBy("new_split").agg(F.count("*").alias("n_rows")).join(F.broadcast(torn), F.lit(True))


def _survivors(spark: SparkSession, sf_dir: str) -> Survivors:
    return Survivors(load(spark, sf_dir, "catalog_wines"), load(spark, sf_dir, "feeds"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survivors(spark, sf_dir).records().select("group_row_id", "field", "best_row_id")


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survivors(spark, sf_dir).records()


def p6_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survivors(spark, sf_dir).values()


def p6_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survivors(spark, sf_dir).source_quality()


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(load(spark, sf_dir, "documents"), "doc_id", "text")


def p7_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(load(spark, sf_dir, "documents"), "doc_id", "text")


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # pack_specs: three rows in all
    specs = [(r.spec_id, r.tokenizer, r.capacity) for r in load(spark, sf_dir, "pack_specs").orderBy("spec_id").collect()]
    parts = [packed.withColumn("spec_id", F.lit(spec_id)) for spec_id, _, packed in pack_specs(load(spark, sf_dir, "documents"), specs)]
    return reduce(DataFrame.unionByName, parts).select("spec_id", "container_id", "doc_id", "part", "start", "n_tokens")


def p8_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and share of unused room of each specification."""
    specs = load(spark, sf_dir, "pack_specs").select("spec_id", "capacity")
    filled = p8_packed(spark, sf_dir).groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("n")).groupBy("spec_id")
    return (
        filled.agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"))
        .join(specs, "spec_id")
        .withColumn("unused_share", F.round(1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 6))
    )


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must never be: containers over their capacity, documents whose pieces do not add up or leave gaps, and documents cut although they fit."""
    documents = load(spark, sf_dir, "documents")
    specs = load(spark, sf_dir, "pack_specs").select("spec_id", "tokenizer", "capacity")
    pieces = cut(p8_packed(spark, sf_dir))
    over = pieces.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("n")).join(specs, "spec_id").groupBy("spec_id").agg(F.count_if(F.col("n") > F.col("capacity")).alias("n_over"))
    # pack_specs: three rows in all
    tokenizers = sorted({r.tokenizer for r in specs.collect()})
    lengths = reduce(DataFrame.unionByName, [count_tokens(documents, "doc_id", "text", t).withColumn("tokenizer", F.lit(t)) for t in tokenizers])
    placed = pieces.groupBy("spec_id", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("n_pieces"), F.max(F.col("start") + F.col("n_tokens")).alias("end"))
    wanted = lengths.select("doc_id", "tokenizer", "n_tokens").join(specs, "tokenizer")
    joined = wanted.join(placed, ["spec_id", "doc_id"], "left")
    wrong = joined.groupBy("spec_id").agg(
        F.count_if(~F.coalesce((F.col("n") == F.col("n_tokens")) & (F.col("end") == F.col("n_tokens")), F.lit(False))).alias("n_lost"),
        F.count_if((F.col("n_tokens") <= F.col("capacity")) & (F.col("n_pieces") > 1)).alias("n_cut"),
    )
    return over.join(wrong, "spec_id")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents")
    return score_documents(documents, fit(documents, load(spark, sf_dir, "doc_labels")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_scores(spark, sf_dir).where(F.col("score") >= THRESHOLD).select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents")
    return rates(documents, fit(documents, load(spark, sf_dir, "doc_labels")))


QUERIES = {
    "p4_found": p4_found,
    "p4_assigned": p4_assigned,
    "p4_totals": p4_totals,
    "p5_found": p5_found,
    "p5_unmatched": p5_unmatched,
    "p6_found": p6_found,
    "p6_records": p6_records,
    "p6_values": p6_values,
    "p6_sources": p6_sources,
    "p7_ids": p7_ids,
    "p7_lengths": p7_lengths,
    "p8_packed": p8_packed,
    "p8_room": p8_room,
    "p8_checks": p8_checks,
    "p9_found": p9_found,
    "p9_scores": p9_scores,
    "p9_rates": p9_rates,
}

_BLANKS = "chr(32) || chr(9) || chr(10) || chr(13) || chr(160)"
_FILLERS = "('-', '—', '???', 'n/a', 'null', 'tbd', 'unknown', 'не указано', 'нет данных', 'н/д')"
_BEST = " UNION ALL ".join(
    f"SELECT slug, '{f}' AS field, row_id, trust, loaded_at, raw_record_count, source_row_no FROM keyed WHERE trim(coalesce({f}, ''), {_BLANKS}) <> '' AND lower(trim({f}, {_BLANKS})) NOT IN {_FILLERS}"
    for f in FIELDS
)

_KEY = "nullif(lower(trim({c}, " + _BLANKS + ")), '')"
ORACLES: dict[str, str] = {
    "p4_found": f"""
WITH RECURSIVE p AS (
  SELECT entry_id, {_KEY.format(c="capture_group")} AS g, {_KEY.format(c="image_sha256")} AS s, {_KEY.format(c="split")} AS sp FROM photo_search_pilot
), e AS (SELECT DISTINCT g, s FROM p WHERE g IS NOT NULL AND s IS NOT NULL
), near AS (SELECT DISTINCT a.g AS a, b.g AS b FROM e a JOIN e b USING (s)
), reach(a, b) AS (
  SELECT g, g FROM (SELECT DISTINCT g FROM p WHERE g IS NOT NULL) UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b
), comp AS (SELECT a AS g, min(b) AS c FROM reach GROUP BY 1
), sc AS (SELECT s, min(c) AS c FROM e JOIN comp USING (g) GROUP BY 1
), rows AS (
  SELECT entry_id, sp, coalesce('g' || comp.c, 'g' || sc.c, 's' || p.s) AS c FROM p LEFT JOIN comp ON comp.g = p.g LEFT JOIN sc ON sc.s = p.s
)
SELECT entry_id FROM rows WHERE c IN (SELECT c FROM rows WHERE c IS NOT NULL GROUP BY c HAVING count(DISTINCT sp) > 1)
""",
    "p4_totals": """
WITH t AS (SELECT split, share / sum(share) OVER () AS share, row_number() OVER (ORDER BY share DESC, split) = count(*) OVER () AS is_last, (SELECT count(*) FROM photo_search_pilot) AS n FROM split_targets)
SELECT split AS new_split, CASE WHEN is_last THEN n - (SELECT sum(round_even(n * share, 0)) FROM t WHERE NOT is_last) ELSE round_even(n * share, 0) END::BIGINT AS n_rows, 0::BIGINT AS n_torn FROM t
""",
    "p8_checks": "SELECT spec_id, 0::BIGINT AS n_over, 0::BIGINT AS n_lost, 0::BIGINT AS n_cut FROM pack_specs",
    "p6_found": f"""
WITH keyed AS (
  SELECT c.* EXCLUDE (slug), regexp_replace(lower(trim(slug, {_BLANKS})), '[-_]+', '-', 'g') AS slug, f.trust FROM catalog_wines c LEFT JOIN feeds f USING (feed)
  WHERE trim(coalesce(slug, ''), {_BLANKS}) <> ''
), groups AS (
  SELECT slug, min(row_id) AS group_row_id FROM keyed GROUP BY slug HAVING count(*) > 1
), best AS (
  SELECT slug, field, first(row_id ORDER BY trust DESC NULLS LAST, loaded_at DESC NULLS LAST, coalesce(raw_record_count, 0) DESC, source_row_no NULLS LAST, row_id) AS best_row_id FROM ({_BEST}) GROUP BY slug, field
)
SELECT group_row_id, field, best_row_id FROM best JOIN groups USING (slug)
""",
}
