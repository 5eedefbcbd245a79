"""Dictionary search of free text: inverted index, rarity weights, gates, top k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvine.functions.tokens import FUZZY_GAP, FUZZY_MIN, PREFIX_MIN, TOKEN_MATCH, decided_similarity, difflib_ratio, undecided


def document_frequency(docs: DataFrame, key: list[str], token: str = "token") -> DataFrame:
    """token, df and weight 1 + ln((N + 1) / (df + 1)) of distinct (key, token) rows."""
    n = docs.select(*key).distinct().agg(F.count("*").alias("n"))
    df = docs.select(*key, token).distinct().groupBy(token).agg(F.count("*").alias("df"))
    # one row on the right
    return df.join(F.broadcast(n), F.lit(True)).select(token, "df", (1 + F.log((F.col("n") + 1) / (F.col("df") + 1))).alias("weight"))


def token_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inverted-index join of (left_id, token) and (right_id, token): pairs with their number of shared tokens, and the share of each side's tokens."""
    nl = left.groupBy("left_id").agg(F.count("*").alias("n_left"))
    nr = right.groupBy("right_id").agg(F.count("*").alias("n_right"))
    shared = left.join(right, "token").groupBy("left_id", "right_id").agg(F.count("*").alias("n_shared"))
    return shared.join(nl, "left_id").join(nr, "right_id").select(
        "left_id", "right_id", "n_shared", (F.col("n_shared") / F.col("n_right")).alias("coverage"), (F.col("n_shared") / F.col("n_left")).alias("precision")
    )


#: Letters of Latin words, the rare ones first: any order is right, a good one makes few pairs.
_RARE_FIRST = "0123456789qxwjfbhczgpyumdkvslternoia"


def _near_lengths(n: Column) -> tuple[Column, Column]:
    return F.greatest(n - FUZZY_GAP, F.lit(FUZZY_MIN)), n + FUZZY_GAP


def _letter_keys(words: DataFrame, name: str, other: str, bound: float, min_length: int = FUZZY_MIN, reach=_near_lengths) -> DataFrame:
    """Keys that two words with a ratio of at least ``bound`` share: ``name``, n_name, n_other, one, two.

    Their matching blocks hold at least bound / 2 of all their letters, so as sets of counted letters
    in one order the first n - that number + 2 of each have two in common. ``n_other``: each length the other word may have (``reach`` of the own one).
    """
    c = F.col(name)
    at = lambda i: F.substring(c, i, F.lit(1))
    nth = lambda i: i - F.length(F.replace(F.substring(c, F.lit(1), i), at(i), F.lit("")))
    counted = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.named_struct(F.lit("rank"), F.position(at(i), F.lit(_RARE_FIRST)) - 12 * nth(i), F.lit("letter"), F.concat(at(i), nth(i).cast("string"))))
    n, m = F.col(f"n_{name}"), F.col(f"n_{other}")
    low, high = reach(F.length(c))
    lengths = words.where(F.length(c) >= min_length).select(
        name, F.length(c).alias(f"n_{name}"), F.transform(F.array_sort(counted), lambda x: x["letter"]).alias("letters"), F.explode(F.sequence(F.greatest(low, F.lit(min_length)), high)).alias(f"n_{other}")
    )
    needed = F.ceil(bound / 2 * (n + m) - 1e-9).cast("int")
    first = lengths.where(needed <= n).withColumn("letters", F.slice("letters", F.lit(1), n - needed + 2))
    ones = first.select(name, n, m, "letters", F.posexplode("letters").alias("i", "one"))
    return ones.select(name, n, m, "one", F.explode(F.slice("letters", F.col("i") + 2, F.size("letters"))).alias("two"))


def similar_words(left: DataFrame, right: DataFrame, bound: float, min_length: int) -> DataFrame:
    """token, query, similarity of different words of at least ``min_length`` letters whose ratio reaches the bound, whatever the gap of their lengths.

    A ratio of at least b leaves lengths between b / (2 - b) and (2 - b) / b of each other, and
    both words share two rare letters for each pair of lengths, so no pair is lost.
    """
    reach = lambda n: (F.ceil(n * bound / (2 - bound) - 1e-9).cast("int"), F.floor(n * (2 - bound) / bound + 1e-9).cast("int"))
    a, b = left.select("token").distinct(), right.select(F.col("token").alias("query")).distinct()
    edits = (1 - bound) * (F.length("token") + F.length("query"))
    close = (F.col("token") != F.col("query")) & (F.levenshtein("token", "query") <= edits)
    pairs = _letter_keys(a, "token", "query", bound, min_length, reach).join(_letter_keys(b, "query", "token", bound, min_length, reach), ["n_token", "n_query", "one", "two"]).where(close).select("token", "query").distinct()
    rated = pairs.repartition("token", "query").withColumn("similarity", difflib_ratio("query", "token"))
    return rated.where(F.col("similarity") >= bound)


def linked_tokens(vocabulary: DataFrame, queries: DataFrame, bound: float = TOKEN_MATCH) -> DataFrame:
    """token, query, similarity of words that read alike. Both sides: one distinct column ``token``.

    A query that is itself a word of the vocabulary only means that word. Of other pairs all that
    reach the bound are found: beginnings of much longer words by their first letters, the rest by
    two shared rare letters for each pair of lengths. Only pairs that their lengths leave undecided
    reach the ratio, once for each pair of distinct words.
    """
    known = queries.join(vocabulary, "token").select("token", F.col("token").alias("query"), F.lit(1.0).alias("similarity"))
    unknown = queries.join(vocabulary, "token", "left_anti").select(F.col("token").alias("query"))

    begin = lambda df, c: df.where(F.length(c) >= PREFIX_MIN).select(c, F.substring(c, 1, PREFIX_MIN).alias("begin"))
    begins = begin(vocabulary, "token").join(begin(unknown, "query"), "begin").select("token", "query", decided_similarity(F.col("token"), F.col("query")).alias("similarity"))
    # matched blocks are a common subsequence, so a ratio of at least the bound leaves no more edits than this
    edits = (1 - bound) * (F.length("token") + F.length("query"))
    close = undecided(F.col("token"), F.col("query")) & (F.levenshtein("token", "query") <= edits)
    # rows are filtered before the Python function, which would else see all of them
    pairs = _letter_keys(vocabulary, "token", "query", bound).join(_letter_keys(unknown, "query", "token", bound), ["n_token", "n_query", "one", "two"]).where(close).select("token", "query").distinct()
    rated = pairs.repartition("token", "query").withColumn("similarity", difflib_ratio("token", "query"))
    near = begins.where(F.col("similarity").isNotNull()).unionByName(rated)
    return known.unionByName(near.where(F.col("similarity") >= bound))


def field_search(values: DataFrame, queries: DataFrame, links: DataFrame | None = None, k: int | None = 5, common: float = 2.0, allow_single: bool = False) -> DataFrame:
    """The ``k`` values (all, if None) that each query text means best: query_id, value, score, rank.

    ``values``: value, token; ``queries``: query_id, token (both distinct); ``links``: token,
    query, similarity of words that count as the same (by default equal words only).

    A value is weighed by the rarity of its words. It needs two matching words, or one that is
    rare (weight ``common`` at least), unless single words are allowed. score = matched weight /
    weight of everything the query matches x matched weight / weight of the value.
    """
    weights = document_frequency(values, ["value"]).select("token", "weight")
    if links is None:
        hits = queries.join(weights, "token").select("query_id", "token", F.lit(1.0).alias("similarity"), "weight")
    else:
        hits = (
            queries.withColumnRenamed("token", "query")
            .join(links, "query")
            .groupBy("query_id", "token")
            .agg(F.max("similarity").alias("similarity"))
            .join(weights, "token")
        )
    hits = hits.select("query_id", "token", "weight", (F.col("weight") * F.col("similarity")).alias("matched"))
    pool = hits.groupBy("query_id").agg(F.sum("matched").alias("pool"))
    whole = values.join(weights, "token").groupBy("value").agg(F.sum("weight").alias("value_weight"))
    found = hits.join(values, "token").groupBy("query_id", "value").agg(F.sum("matched").alias("matched"), F.count("*").alias("n"), F.max("weight").alias("rarest"))
    if not allow_single:
        found = found.where((F.col("n") >= 2) | (F.col("rarest") >= common))
    scored = found.join(pool, "query_id").join(whole, "value").select("query_id", "value", F.round(F.col("matched") / F.col("pool") * F.col("matched") / F.col("value_weight"), 4).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "value")
    ordered = scored.withColumn("rank", F.row_number().over(order))
    return ordered if k is None else ordered.where(F.col("rank") <= k)


def cooccurring(pairs: DataFrame, min_count: int = 2, min_share: float = 0.3) -> DataFrame:
    """left, right, seen, share of values that occur together in rows. ``pairs``: id, left, right (distinct)."""
    seen = pairs.groupBy("left", "right").agg(F.count_distinct("id").alias("seen"))
    total = pairs.groupBy("left").agg(F.count_distinct("id").alias("total"))
    return seen.join(total, "left").withColumn("share", F.round(F.col("seen") / F.col("total"), 6)).where((F.col("seen") >= min_count) & (F.col("seen") / F.col("total") >= min_share)).drop("total")


def spread_tokens(df: DataFrame, token: str, owner: str, more_than: int = 2) -> DataFrame:
    """Tokens that more than so many owners use."""
    return df.groupBy(token).agg(F.count_distinct(owner).alias("n_owners")).where(F.col("n_owners") > more_than)


def any_keyword(docs: DataFrame, tokens: Column, keywords: list[list[str]]) -> DataFrame:
    """Full-text filter: rows that hold all words of at least one keyword."""
    test = F.lit(False)
    for needed in keywords:
        test = test | (F.size(F.array_except(F.array(*map(F.lit, needed)), tokens)) == 0)
    return docs.where(test)
