"""What the words of a label mean in each field of a catalogue: rarity-weighted search, the winery first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvine.functions.tokens import TOKEN_MATCH
from corvine.session import cut

# Weight from which a word is rare, candidates of a field, score from which a winery uses up its words, share that names of other wineries keep.
RARE, CANDIDATES, SPENDS_AT, OTHER_FACTOR = 2.0, 50, 0.5, 0.5
#: Words of a query that go along with each of them; queries with more are added up row by row.
CARRIED = 64


def alike(words: DataFrame, key: str, by: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """key, set_id; and set_id, ``by``, ``columns`` once: keys with the same ``by`` and the same rows are one set, told by the md5 of its text."""
    sets = words.groupBy(key, *by).agg(F.sort_array(F.collect_set(F.struct(*columns))).alias("w"))
    sets = cut(sets.withColumn("set_id", F.md5(F.to_json(F.struct(*by, "w")).cast("binary"))))
    return sets.select(key, "set_id"), sets.dropDuplicates(["set_id"]).select("set_id", *by, F.inline("w"))


def search(values: DataFrame, queries: DataFrame, links: DataFrame, by: list[str], k: int = CANDIDATES, single: bool = False, weak: DataFrame | None = None) -> DataFrame:
    """query_id, ``by``, value, score: the ``k`` values that each query means best, in each part ``by`` of the values on its own.

    ``values``: by, value, token (distinct); ``queries``: query_id, by, query (distinct); ``links``:
    token, query, similarity. A part weighs its words by their rarity among its own values. A
    value needs two words, or a rare one, unless ``single``; one that is met in ``weak`` words
    (column token) alone does not count. score = matched weight / everything matched x matched
    weight / weight of the value.
    """
    n = values.select(*by, "value").distinct().groupBy(*by).agg(F.count("*").alias("n"))
    df = values.groupBy(*by, "token").agg(F.count("*").alias("df"))
    # without parts the number of values is one row
    weights = (df.join(n, by) if by else df.join(F.broadcast(n), F.lit(True))).select(*by, "token", (1 + F.log((F.col("n") + 1) / (F.col("df") + 1))).alias("weight"))
    met = queries.join(links, "query").groupBy("query_id", *by, "token").agg(F.max("similarity").alias("similarity"))
    met = met.join(values.select(*by, "token").distinct(), [*by, "token"], "left_semi")
    sets, asked = alike(met, "query_id", by, ["token", "similarity"])
    hits = cut(asked.join(weights, [*by, "token"]).withColumn("matched", F.col("weight") * F.col("similarity")))
    pool = hits.groupBy("set_id").agg(F.sum("matched").alias("pool"), F.count("*").alias("n"))
    told = values.join(weights, [*by, "token"])
    if weak is not None:
        told = told.join(weak.select("token").distinct().withColumn("is_weak", F.lit(True)), "token", "left")
    told = told.withColumn("is_weak", F.col("is_weak").isNotNull() if weak is not None else F.lit(False))
    whole = told.groupBy(*by, "value").agg(F.sum("weight").alias("whole"), F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("order"), "token", "weight", "is_weak"))).alias("words"))
    # Values that share one word with a query are ranked by their weight: the first k of each word are enough.
    # Those that share more are found by the rarest of them, which is not the value's most frequent word.
    place = Window.partitionBy(*by, "token").orderBy(F.round("whole", 9), "value")
    index = whole.select(*by, "value", "whole", "words", F.posexplode("words").alias("i", "w")).select(*by, "value", "whole", "words", "i", F.col("w.token").alias("token"))
    index = cut(index.withColumn("is_first", F.row_number().over(place) <= k).where((F.col("i") < F.size("words") - 1) | F.col("is_first")))
    carried = hits.groupBy("set_id", *by).agg(F.map_from_entries(F.collect_list(F.struct("token", "matched"))).alias("of"), F.sum("matched").alias("pool"), F.count("*").alias("n")).where(F.col("n") <= CARRIED)
    shared = F.filter("words", lambda w: F.map_contains_key("of", w["token"]))
    # few rows that become many: in as many tasks as there are partitions, which small tables would else not get
    carried = carried.repartition(int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions")), "set_id")
    light = carried.select("set_id", *by, "of", "pool", F.explode(F.map_keys("of")).alias("token")).join(index, [*by, "token"]).withColumn("shared", shared)
    light = light.where(F.when(F.size("shared") == 1, F.col("is_first")).otherwise(F.get("shared", F.lit(0))["token"] == F.col("token")))
    light = light.select(
        "set_id", *by, "value", "pool", "whole", F.aggregate("shared", F.lit(0.0), lambda x, w: x + F.element_at("of", w["token"])).alias("m"), F.size("shared").cast("long").alias("words"),
        F.array_max(F.transform("shared", lambda w: w["weight"])).alias("rarest"), F.exists("shared", lambda w: ~w["is_weak"]).alias("strong"),
    )
    many = hits.join(pool.where(F.col("n") > CARRIED).drop("n"), "set_id").join(told.select(*by, "value", "token", "is_weak"), [*by, "token"])
    many = many.groupBy("set_id", *by, "value", "pool").agg(F.sum("matched").alias("m"), F.count("*").alias("words"), F.max("weight").alias("rarest"), F.bool_or(~F.col("is_weak")).alias("strong"))
    many = many.join(whole.drop("words"), [*by, "value"])
    found = light.unionByName(many)
    kept = found.where(F.col("strong") & (F.lit(single) | (F.col("words") >= 2) | (F.col("rarest") >= RARE)))
    scored = kept.select("set_id", *by, "value", (F.col("m") / F.col("pool") * F.col("m") / F.col("whole")).alias("raw"))
    order = Window.partitionBy("set_id").orderBy(F.desc(F.round("raw", 9)), "value")
    top = cut(scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    return top.join(sets, "set_id").select("query_id", *by, "value", F.round("raw", 4).alias("score"), "rank")


def without(values: DataFrame, excluded: DataFrame) -> DataFrame:
    """``values`` (value, token) less the words ``excluded`` (value, token) of each, unless none would be left."""
    left = values.join(excluded, ["value", "token"], "left_anti")
    bare = values.join(left.select("value").distinct(), "value", "left_anti")
    return left.unionByName(bare)


def explained(queries: DataFrame, chosen: DataFrame, values: DataFrame, links: DataFrame) -> DataFrame:
    """query_id, query: the words of each query that a word of its chosen value (query_id, value) stands for."""
    words = chosen.join(values, "value").select("query_id", "token")
    return queries.select("query_id", "query").join(links.where(F.col("similarity") >= TOKEN_MATCH), "query").join(words, ["query_id", "token"]).select("query_id", "query").distinct()


def winery_first(wineries: DataFrame, names: DataFrame, names_of: DataFrame, queries: DataFrame, links: DataFrame, weak: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates of winery and of name: query_id, value, score, rank each.

    The winery is searched first. Where the best one scores ``SPENDS_AT`` or more it uses up the
    words that it explains: the names are searched by the rest, among those of this winery (one
    word is enough there), the best of which scores 1, and in the whole catalogue at
    ``OTHER_FACTOR``; the better score of a name counts. Elsewhere the names are searched by all words.

    ``wineries``, ``names``: value, token; ``names_of``: winery, value, token; ``queries``:
    query_id, query; ``links``: token, query, similarity; ``weak``: token.
    """
    first = search(wineries, queries, links, [], weak=weak)
    top = first.where((F.col("rank") == 1) & (F.col("score") >= SPENDS_AT)).select("query_id", F.col("value").alias("winery"))
    spent = explained(queries, top.withColumnRenamed("winery", "value"), wineries, links)
    rest = queries.join(spent, ["query_id", "query"], "left_anti")
    # labels with the same winery and the same words of names mean the same names
    meant = links.join(names.select("token").distinct(), "token", "left_semi").select("query").distinct()
    asking, asked = alike(rest.join(meant, "query", "left_semi").join(top, "query_id", "left"), "query_id", ["winery"], ["query"])
    asked = cut(asked.withColumnRenamed("set_id", "query_id"))
    top = asked.where("winery is not null").select("query_id", "winery").distinct()
    whole = search(names, asked.select("query_id", "query"), links, [])
    # only the names of wineries that some label shows are searched
    own = search(names_of.join(top.select("winery").distinct(), "winery", "left_semi"), asked.where("winery is not null"), links, ["winery"], single=True)
    best = own.groupBy("query_id").agg(F.max("score").alias("top"))
    # scores of a query's own winery only; a best score of 0 leaves them as they are
    own = own.join(best, "query_id").select("query_id", "value", F.round(F.try_divide("score", "top"), 4).alias("score"))
    led = whole.join(top.select("query_id"), "query_id", "left_semi").select("query_id", "value", (F.col("score") * OTHER_FACTOR).alias("score"))
    plain = whole.join(top.select("query_id"), "query_id", "left_anti").select("query_id", "value", "score")
    merged = own.unionByName(led).unionByName(plain).groupBy("query_id", "value").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "value")
    merged = cut(merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= CANDIDATES))
    return first, merged.withColumnRenamed("query_id", "set_id").join(asking, "set_id").select("query_id", "value", "score", "rank")
