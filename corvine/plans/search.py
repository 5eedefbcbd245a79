"""Text and dictionary-search queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions import tokens as T
from corvine.functions.stemming import stem, stems
from corvine.functions.text import clean
from corvine.operators.catalog import keep_first
from corvine.operators.search import any_keyword, cooccurring, document_frequency, field_search, linked_tokens, spread_tokens, token_pairs
from corvine.session import ship_package
from corvine.sources.tables import load


def _tokens(df: DataFrame, key: str, text: Column, as_key: str | None = None, **options) -> DataFrame:
    return df.select(F.col(key).alias(as_key or key), F.explode(T.words(text, **options)).alias("token"))


def token_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = document_frequency(_tokens(load(spark, sf_dir, "catalog_wines"), "row_id", F.col("name")), ["row_id"])
    return out.select("token", "df", F.round("weight", 6).alias("weight"))


def _wineries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "canonical_values").where("field = 'winery'")


def token_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _tokens(load(spark, sf_dir, "documents"), "doc_id", F.col("text"), "left_id", min_length=5)
    right = _tokens(load(spark, sf_dir, "canonical_values"), "canon_id", F.col("canon_value"), "right_id", min_length=5)
    pairs = token_pairs(left, right).where(F.col("coverage") >= 1)
    return pairs.select("left_id", "right_id", "n_shared", F.round(0.8 * F.col("coverage") + 0.2 * F.col("precision"), 6).alias("score"))


def document_wineries(spark: SparkSession, sf_dir: str, k: int | None) -> DataFrame:
    """The best ``k`` listed wineries that each document names, or all of them."""
    values = _tokens(_wineries(spark, sf_dir), "canon_value", F.col("canon_value"), "value")
    return field_search(values, _tokens(load(spark, sf_dir, "documents"), "doc_id", F.col("text"), "query_id"), k=k)


def field_search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed wineries that each document names, best five."""
    return document_wineries(spark, sf_dir, 5)


def field_search_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for wineries as read from labels, with misread words."""
    ship_package(spark)
    values = _tokens(_wineries(spark, sf_dir), "canon_value", F.col("canon_value"), "value")
    read = load(spark, sf_dir, "field_candidates").where("field = 'winery'").select("value").distinct()
    queries = _tokens(read, "value", F.col("value"), "query_id")
    links = linked_tokens(values.select("token").distinct(), queries.select("token").distinct())
    return field_search(values, queries, links, allow_single=True)


def phonetic_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound key of every distinct word of the catalogue names."""
    distinct = _tokens(load(spark, sf_dir, "catalog_wines"), "row_id", F.concat_ws(" ", "name", "winery", "region")).select("token").distinct()
    return distinct.select("token", T.phonetic_key(F.col("token")).alias("key"))


def homophones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different words with one sound key: the words of each key, counted."""
    keys = phonetic_keys(spark, sf_dir)
    return keys.groupBy("key").agg(F.count("*").alias("n_words"), F.min("token").alias("low"), F.max("token").alias("high")).where("n_words > 1")


def sugar_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = load(spark, sf_dir, "catalog_wines")
    return w.select("row_id", F.coalesce(*(T.sugar_level(F.col(c)) for c in ("name", "slug", "source_image_filename"))).alias("level"))


def year_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "catalog_wines").select("row_id", T.vintage(F.col("name")).alias("vintage"), T.card_year(F.col("name")).alias("card_year"))


def year_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years read for each scan: candidates of the field, the best score of each year, kept if only one year was read or it is the best."""
    c = load(spark, sf_dir, "field_candidates").where("field = 'year'").select("scan_id", F.col("value").try_cast("int").alias("year"), "score").where("year between 1950 and 2029")
    best = c.groupBy("scan_id", "year").agg(F.max("score").alias("score"))
    return best.groupBy("scan_id").agg(F.count("*").alias("n_years"), F.max_by("year", F.struct("score", F.col("year"))).alias("year"))


def abv_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", T.alcohol_contents(F.col("text")).alias("found")).where(F.size("found") > 0)
    return d.select("doc_id", F.size("found").alias("n"), F.array_min("found").alias("low"), F.array_max("found").alias("high"))


def line_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least score of each line (scan, field, rank), then the best line of each value; lines below 0.4 do not count."""
    c = load(spark, sf_dir, "field_candidates").where("value is not null and score is not null")
    lines = c.groupBy("scan_id", "field", "pos", "value").agg(F.min("score").alias("score")).where("score >= 0.4")
    return lines.groupBy("scan_id", "field", "value").agg(F.max("score").alias("score"), F.count("*").alias("n_lines"))


def alias_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = load(spark, sf_dir, "catalog_wines")
    left = w.select("row_id", F.explode(T.words(F.col("winery"))).alias("left"), T.words(F.col("region")).alias("r"))
    return cooccurring(left.select(F.col("row_id").alias("id"), "left", F.explode("r").alias("right")))


def generic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_tokens(_tokens(_wineries(spark, sf_dir), "canon_id", F.col("canon_value")), "token", "canon_id", 2)


_KEYWORDS = [["tanny", "kislotnost"], ["cork", "dry"], ["pogrebe"]]


def fulltext_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return any_keyword(load(spark, sf_dir, "documents"), T.words(F.col("text")), _KEYWORDS).select("doc_id")


def fulltext_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold, in any inflected form, all words of one of two queries."""
    ship_package(spark)
    wanted = [[stem(w) for w in words] for words in (["виноградник", "бутылка"], ["дегустация"])]
    return any_keyword(load(spark, sf_dir, "documents").withColumn("__stems", stems("text")), F.col("__stems"), wanted).select("doc_id")


def homoglyph_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with look-alike letters in the script they belong to."""
    return load(spark, sf_dir, "field_candidates").where("value is not null").select("candidate_id", T.fold_looks(F.col("value")).alias("folded"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.explode(F.split("text", r"[\n.!?]+ *"))
    return load(spark, sf_dir, "documents").where("text is not null").select("doc_id", lines.alias("line"))


def year_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of each text: those of lines that speak of a harvest, else the only year of the other lines; lines of foundation or bottling do not count."""
    years = F.transform(F.regexp_extract_all("line", F.lit(T.VINTAGE), F.lit(1)), lambda y: y.cast("int"))
    found = _lines(spark, sf_dir).where(~F.lower("line").rlike(T.NO_HARVEST)).select("doc_id", F.lower("line").rlike(T.HARVEST).alias("is_marked"), F.explode(years).alias("year")).distinct()
    each = found.groupBy("doc_id").agg(F.collect_set(F.when(F.col("is_marked"), F.col("year"))).alias("marked"), F.collect_set("year").alias("all"))
    return each.where((F.size("marked") > 0) | (F.size("all") == 1)).select("doc_id", F.explode(F.when(F.size("marked") > 0, F.col("marked")).otherwise(F.col("all"))).alias("year"), (F.size("marked") > 0).alias("is_marked"))


def strength_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strengths printed on the lines of each text, also behind ``alc``."""
    return _lines(spark, sf_dir).select("doc_id", F.explode(T.line_strengths(F.col("line"))).alias("strength")).groupBy("doc_id", "strength").agg(F.count("*").alias("n"))


_TAGS = (("fruit", "груш|слив|вишн|яблок|pear|plum|cherry|apple"), ("oak", "дуб|ванил|oak|vanilla"), ("price", "цен|бюджет|₽|rouble"), ("service", "сотрудник|хозяин|staff|owner"), ("food", "сыр|рыб|шашлык|cheese|lamb|perch"))


def taste_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of every document by word stems, in fixed order."""
    low = F.lower("text")
    tags = F.array_join(F.filter(F.array(*(F.when(low.rlike(p), F.lit(n)) for n, p in _TAGS)), lambda x: x.isNotNull()), ",")
    return load(spark, sf_dir, "documents").where("text is not null").select("doc_id", tags.alias("tags"))


def rule_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of every document by the first rule that holds, counted by source."""
    text = F.lower(clean(F.col("text")))
    kind = F.when(text.isNull(), "blank").when(text.rlike("сомелье:|sommelier:|гость:|guest:"), "dialogue").when(text.rlike(r"price=\d+;stock="), "record").when(F.length(text) > 800, "long").otherwise("plain")
    return load(spark, sf_dir, "documents").groupBy("source", kind.alias("kind")).agg(F.count("*").alias("n"))


def stable_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "catalog_wines").where("slug is not null").select("row_id", F.pmod(T.stable_hash(F.col("slug")), F.lit(12)).alias("bucket"))


_PROFILES = (("orchard", ("груш", "вишн", "pear")), ("cellar", ("погреб", "cellar", "дуб")), ("table", ("сыр", "рыб", "cheese")), ("road", ("автобус", "bus", "дорог")))


def best_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile with most terms in each document, the first of equals; without any term the stable hash of the source chooses."""
    low = F.lower("text")
    counts = [sum((F.when(F.contains(low, F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0)) for _, terms in _PROFILES]
    best = F.greatest(*counts)
    chosen = F.lit(None).cast("string")
    for (name, _), count in reversed(list(zip(_PROFILES, counts))):
        chosen = F.when(count == best, name).otherwise(chosen)
    other = F.element_at(F.array(*(F.lit(n) for n, _ in _PROFILES)), (F.pmod(T.stable_hash(F.coalesce("source", F.lit(""))), F.lit(len(_PROFILES))) + 1).cast("int"))
    return load(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.when(best > 0, chosen).otherwise(other).alias("profile"), best.alias("n_terms"))


def first_proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best read value of each scan and field."""
    c = load(spark, sf_dir, "field_candidates").where("value is not null")
    return keep_first(c, ["scan_id", "field"], [F.col("score").desc_nulls_last(), F.col("value"), F.col("candidate_id")]).select("scan_id", "field", "value", "score")


QUERIES = {f.__name__: f for f in (
    token_idf, token_blocking, field_search_exact, field_search_fuzzy, phonetic_keys, homophones, sugar_levels, year_extract, year_candidates, abv_extract, line_candidates, alias_cooccurrence,
    generic_tokens, fulltext_any, fulltext_stemmed, homoglyph_fold, year_lines, strength_lines, taste_tags, rule_chain, stable_hash, best_profile, first_proposal,
)}


def _latin(c: str) -> str:
    out = f"translate(translate(lower({c}), '{T.ACCENTS[0]}', '{T.ACCENTS[1]}'), '{T.ONE_SIGN[0]}', '{T.ONE_SIGN[1]}')"
    for old, new in T.MANY_SIGNS.items():
        out = f"replace({out}, '{old}', '{new}')"
    return f"translate({out}, 'ъь', '')"


def _words(c: str, n: int = 3) -> str:
    stop = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
    return f"list_distinct(list_filter(regexp_extract_all({_latin(c)}, '[a-z0-9]+'), lambda t: length(t) >= {n} AND NOT regexp_full_match(t, '\\d+') AND t NOT IN ({stop})))"


def _level(c: str) -> str:
    """Nested: the text after each replacement, and which levels it named."""
    text = f"(' ' || regexp_replace(replace(lower({c}), 'ё', 'е'), '[\\s_./,;:()«»\"''-]+', ' ', 'g') || ' ')"
    tests = []
    for level, pattern in T.SUGAR:
        pattern = pattern.replace("(?= )", "( )")
        tests.append(f"CASE WHEN regexp_matches({text}, '{pattern}') THEN '{level}' END")
        text = f"regexp_replace({text}, '{pattern}', ' ', 'g')"
    found = f"list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL)"
    brut = ", ".join(f"'{b}'" for b in (T.BRUT, T.EXTRA_BRUT, T.BRUT_NATURE))
    left = f"CASE WHEN len({found}) > 1 AND len(list_filter({found}, lambda x: x NOT IN ({brut}))) = 0 THEN list_filter({found}, lambda x: x <> '{T.BRUT}') ELSE {found} END"
    return f"CASE WHEN len({left}) = 1 THEN ({left})[1] END"


_DOC = f"WITH d AS (SELECT doc_id, unnest({_words('text')}) AS token FROM documents), v AS (SELECT canon_value AS value, unnest({_words('canon_value')}) AS token FROM canonical_values WHERE field = 'winery')"
_HASH = "list_reduce(list_prepend(0::BIGINT, list_transform(list_filter(string_split({c}, ''), lambda s: s <> ''), lambda s: unicode(s)::BIGINT)), lambda h, s: (h * 31 + s) % 4294967296)"
_COUNTS = ", ".join("(" + " + ".join(f"contains(lower(text), '{t}')::INT" for t in terms) + f") AS c{i}" for i, (_, terms) in enumerate(_PROFILES))

ORACLES = {
    "token_idf": f"WITH t AS (SELECT row_id, unnest({_words('name')}) AS token FROM catalog_wines), n AS (SELECT count(DISTINCT row_id) AS n FROM t) SELECT token, count(*) AS df, round(1 + ln((n + 1) / (count(*) + 1)), 6) AS weight FROM t, n GROUP BY token, n",
    "token_blocking": f"WITH l AS (SELECT doc_id, unnest({_words('text', 5)}) AS token FROM documents), r AS (SELECT canon_id, unnest({_words('canon_value', 5)}) AS token FROM canonical_values), nl AS (SELECT doc_id, count(*) AS n FROM l GROUP BY 1), nr AS (SELECT canon_id, count(*) AS n FROM r GROUP BY 1) SELECT doc_id AS left_id, canon_id AS right_id, count(*) AS n_shared, round(0.8 * count(*) / nr.n + 0.2 * count(*) / nl.n, 6) AS score FROM l JOIN r USING (token) JOIN nl USING (doc_id) JOIN nr USING (canon_id) GROUP BY doc_id, canon_id, nl.n, nr.n HAVING count(*) >= nr.n",
    "field_search_exact": _DOC
    + ", n AS (SELECT count(DISTINCT value) AS n FROM v), w AS (SELECT token, 1 + ln((n + 1) / (count(*) + 1)) AS weight FROM v, n GROUP BY token, n), h AS (SELECT doc_id, token, weight FROM d JOIN w USING (token)), pool AS (SELECT doc_id, sum(weight) AS pool FROM h GROUP BY 1), vw AS (SELECT value, sum(weight) AS vw FROM v JOIN w USING (token) GROUP BY 1), "
    + "s AS (SELECT doc_id AS query_id, value, round(sum(weight) / any_value(pool) * sum(weight) / any_value(vw), 4) AS score FROM h JOIN v USING (token) JOIN pool USING (doc_id) JOIN vw USING (value) GROUP BY doc_id, value HAVING count(*) >= 2 OR max(weight) >= 2) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, value) AS rank FROM s QUALIFY rank <= 5",
    "sugar_levels": "SELECT row_id, coalesce(" + ", ".join(_level(c) for c in ("name", "slug", "source_image_filename")) + ") AS level FROM catalog_wines",
    "year_extract": r"WITH y AS (SELECT row_id, name, list_distinct(regexp_extract_all(' ' || name || ' ', '[^\d./-](19[5-9]\d|20[0-2]\d)(?:[^\d./-]|[./-][^\d])', 1)) AS f FROM catalog_wines) SELECT row_id, CASE WHEN len(f) = 1 THEN f[1]::INT END AS vintage, nullif(regexp_extract(' ' || name || ' ', '[^\d]((?:19|20)\d\d)[^\d]', 1), '')::INT AS card_year FROM y",
    "year_candidates": "WITH c AS (SELECT scan_id, try_cast(value AS INT) AS year, max(score) AS score FROM field_candidates WHERE field = 'year' AND try_cast(value AS INT) BETWEEN 1950 AND 2029 AND value NOT LIKE '%.%' GROUP BY 1, 2) SELECT scan_id, count(*) AS n_years, last(year ORDER BY score NULLS FIRST, year) AS year FROM c GROUP BY 1",
    "abv_extract": r"WITH f AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(' ' || text, '[^\d.,](\d{1,2}(?:[.,]\d)?)\s*(?:%|об[^а-яёa-z0-9_])', 1), lambda x: replace(x, ',', '.')::DOUBLE), lambda x: x BETWEEN 1 AND 30) AS v FROM documents) SELECT doc_id, len(v)::INT AS n, list_min(v) AS low, list_max(v) AS high FROM f WHERE len(v) > 0",
    "line_candidates": "WITH l AS (SELECT scan_id, field, pos, value, min(score) AS score FROM field_candidates WHERE value IS NOT NULL AND score IS NOT NULL GROUP BY ALL HAVING min(score) >= 0.4) SELECT scan_id, field, value, max(score) AS score, count(*) AS n_lines FROM l GROUP BY ALL",
    "alias_cooccurrence": f"WITH p AS (SELECT row_id, l, unnest(r) AS r FROM (SELECT row_id, unnest({_words('winery')}) AS l, {_words('region')} AS r FROM catalog_wines)), t AS (SELECT l, count(DISTINCT row_id) AS total FROM p GROUP BY 1) SELECT l AS left, r AS right, count(DISTINCT row_id) AS seen, round(count(DISTINCT row_id) / total, 6) AS share FROM p JOIN t USING (l) GROUP BY l, r, total HAVING count(DISTINCT row_id) >= 2 AND count(DISTINCT row_id) / total >= 0.3",
    "generic_tokens": f"WITH t AS (SELECT canon_id, unnest({_words('canon_value')}) AS token FROM canonical_values WHERE field = 'winery') SELECT token, count(DISTINCT canon_id) AS n_owners FROM t GROUP BY 1 HAVING count(DISTINCT canon_id) > 2",
    "fulltext_any": f"WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents) SELECT doc_id FROM d WHERE " + " OR ".join("list_has_all(w, [" + ", ".join(f"'{x}'" for x in k) + "])" for k in _KEYWORDS),
    "homoglyph_fold": f"WITH t AS (SELECT candidate_id, unnest(list_filter(string_split_regex(translate(value, '{T.GREEK[0]}', '{T.GREEK[1]}'), '\\s+'), lambda x: x <> '')) AS t, unnest(range(1, len(list_filter(string_split_regex(translate(value, '{T.GREEK[0]}', '{T.GREEK[1]}'), '\\s+'), lambda x: x <> '')) + 1)) AS i FROM field_candidates WHERE value IS NOT NULL), k AS (SELECT *, translate(t, '{T.LOOKS[0]}', '{T.LOOKS[1]}') AS k, regexp_replace(t, '[^\\p{{L}}]', '', 'g') AS b FROM t), "
    + "o AS (SELECT *, CASE WHEN length(regexp_replace(t, '[^0-9]', '', 'g')) = 1 THEN regexp_replace(regexp_replace(k, '(\\p{L})3', '\\1З', 'g'), '3(\\p{L})', 'З\\1', 'g') ELSE k END AS o FROM k), "
    + f"f AS (SELECT candidate_id, i, CASE WHEN regexp_matches(t, '[\u0400-\u04ff]') THEN o ELSE concat_ws(' ', t, CASE WHEN length(b) < {T.LEAST_LETTERS} THEN NULL WHEN t = upper(t) AND regexp_full_match(b, '[{T.LOOK_CAPITALS}]+') THEN o WHEN t = upper(t) AND contains(t, 'U') THEN replace(t, 'U', 'V') WHEN regexp_matches(t, '[63]') AND regexp_full_match(b, '[{T.LOOK_CAPITALS}{T.LOOK_SMALL}]+') THEN translate(k, '{T.DIGIT_LETTERS[0]}', '{T.DIGIT_LETTERS[1]}') END) END AS f FROM o) "
    + "SELECT candidate_id, coalesce(string_agg(f, ' ' ORDER BY i), '') AS folded FROM (SELECT candidate_id FROM field_candidates WHERE value IS NOT NULL) LEFT JOIN f USING (candidate_id) GROUP BY 1",
    "year_lines": f"WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '[\\n.!?]+ *')) AS line FROM documents WHERE text IS NOT NULL), y AS (SELECT DISTINCT doc_id, regexp_matches(lower(line), '{T.HARVEST}') AS m, unnest(regexp_extract_all(' ' || line || ' ', '[^\\d./-](19[5-9]\\d|20[0-2]\\d)(?:[^\\d./-]|[./-][^\\d])', 1))::INT AS year FROM l WHERE NOT regexp_matches(lower(line), '{T.NO_HARVEST}')), g AS (SELECT doc_id, list(DISTINCT year) FILTER (m) AS marked, list(DISTINCT year) AS ys FROM y GROUP BY 1) SELECT doc_id, unnest(CASE WHEN len(marked) > 0 THEN marked ELSE ys END) AS year, coalesce(len(marked) > 0, false) AS is_marked FROM g WHERE len(marked) > 0 OR len(ys) = 1",
    "strength_lines": r"WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '[\n.!?]+ *')) AS line FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(' ' || line || ' ', '[^\d.,](\d{1,2}(?:[.,]\d)?)\s*(?:%|об[^а-яёa-z0-9_])', 1), regexp_extract_all(' ' || line || ' ', '(?i)[^a-z0-9_а-яё]alc\.?\s*(\d{1,2}(?:[.,]\d)?)[^\d.,]', 1))) AS s FROM l) SELECT doc_id, replace(s, ',', '.')::DOUBLE AS strength, count(*) AS n FROM f WHERE replace(s, ',', '.')::DOUBLE BETWEEN 1 AND 30 GROUP BY 1, 2",
    "taste_tags": "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{n}' END" for n, p in _TAGS) + "], lambda x: x IS NOT NULL), ',') AS tags FROM documents WHERE text IS NOT NULL",
    "rule_chain": r"WITH t AS (SELECT source, lower(nullif(trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(160) || chr(8195) || chr(8201) || chr(12288)), '')) AS t FROM documents) SELECT source, CASE WHEN t IS NULL THEN 'blank' WHEN regexp_matches(t, 'сомелье:|sommelier:|гость:|guest:') THEN 'dialogue' WHEN regexp_matches(t, 'price=\d+;stock=') THEN 'record' WHEN length(t) > 800 THEN 'long' ELSE 'plain' END AS kind, count(*) AS n FROM t GROUP BY ALL",
    "stable_hash": f"SELECT row_id, {_HASH.format(c='slug')} % 12 AS bucket FROM catalog_wines WHERE slug IS NOT NULL",
    "best_profile": f"WITH c AS (SELECT doc_id, source, {_COUNTS} FROM documents WHERE text IS NOT NULL), b AS (SELECT *, greatest({', '.join(f'c{i}' for i in range(len(_PROFILES)))}) AS best FROM c) SELECT doc_id, CASE WHEN best = 0 THEN [{', '.join(repr(n) for n, _ in _PROFILES)}][(CASE WHEN coalesce(source, '') = '' THEN 0 ELSE {_HASH.format(c='source')} END % {len(_PROFILES)} + 1)::INT] " + " ".join(f"WHEN c{i} = best THEN '{n}'" for i, (n, _) in enumerate(_PROFILES)) + " END AS profile, best AS n_terms FROM b",
    "first_proposal": "SELECT scan_id, field, value, score FROM field_candidates WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY scan_id, field ORDER BY score DESC NULLS LAST, value, candidate_id) = 1",
}
