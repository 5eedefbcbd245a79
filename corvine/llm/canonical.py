"""Free-entered values mapped to the entry of a reference list that they mean."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvine.session import cut, ship_package
from corvine.llm.spelling import allowed, cost, letters, osa, readings, skeleton

#: Set similarity that a reading and a listed name share at least: none, as a name without one of its words or in abbreviations shares few of the listed letters.
THRESHOLD = 0.0
#: A word that stands beside so many different listed names is decoration.
SPREAD = 3
#: Keys of listed names (some dozen a name, below 1 kB each) up to which the list is sent to every executor; a longer list is shuffled.
BROADCAST_KEYS = 50_000

_ALPHABET = "^$abcdefghijklmnopqrstuvwxyz0123456789"
_SIGN = {ch: i for i, ch in enumerate(_ALPHABET)}
#: The edits that the longest names may carry.
_EDITS = 2
_NONE: frozenset = frozenset()
#: A token that every set holds, so that names of one letter have two as well.
_PAD = 1


def tokens(reading: str) -> list[int]:
    """The set of a reading: pairs of neighbouring letters (word ends included) and counted letters, as numbers. At most some 38 * 38 + 36 * 64 numbers exist."""
    found = set()
    seen: Counter = Counter()
    for word in reading.replace(".", "").replace("-", "").split(" "):
        edge = f"^{word}$"
        found.update(_SIGN[a] * 64 + _SIGN[b] for a, b in zip(edge, edge[1:]))
        for ch in word:
            seen[ch] += 1
            if seen[ch] < 64:
                found.add((100 + _SIGN[ch]) * 64 + seen[ch])
    return sorted(found)


def counted(word: str) -> list[int]:
    """The counted letters of a word as numbers. Of two words k edits apart, each lacks at most k numbers of the other, in whatever order the letters stand."""
    seen: Counter = Counter(word)
    return sorted(ord(ch) * 64 + i for ch, n in seen.items() for i in range(1, min(n, 63) + 1))


def value_forms(text: str, extra: frozenset = _NONE, own: frozenset = _NONE) -> list[tuple[str, str, int]]:
    """What a value is looked up by: sort of form, letters, how many of them the listed name may lack.

    Sorts: ``whole`` reading; ``part``, a reading with abbreviations, whose letters are some of the name's; ``letters``, the closer form.
    """
    found = []
    for reading in readings(text, extra, own):
        bare = reading.replace(" ", "").replace(".", "").replace("-", "")
        found.append(("whole", bare, _EDITS))
        if "." in reading or "-" in reading:
            # head and tail of x-yy may be the same letters of the name: any shared letter counts
            found.append(("part", bare, len(bare) - 1 if "-" in reading else min(_EDITS, len(bare) - 1)))
    found.append(("letters", letters(text, extra, own), _EDITS))
    return [f for f in dict.fromkeys(found) if f[1]]


def name_forms(text: str, gone: frozenset = _NONE) -> list[tuple[str, str, int]]:
    """What a listed name is found by: sort of form, letters, how many of them a value may lack. Each reading stands whole and without one of the words (skeletons) in ``gone``."""
    found = []
    for reading in readings(text):
        words = reading.split(" ")
        options = [words] + [words[:i] + words[i + 1 :] for i, w in enumerate(words) if w in gone and len(words) > 1]
        for option in map("".join, options):
            found += [("whole", option, allowed(len(option))), ("part", option, len(option))]
    closer = letters(text)
    found.append(("letters", closer, allowed(len(closer))))
    return [f for f in dict.fromkeys(found) if f[1]]


_FORMS = T.ArrayType(
    T.StructType([T.StructField("sort", T.StringType()), T.StructField("ordered", T.ArrayType(T.IntegerType())), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("lacks", T.IntegerType())])
)


def _forms(of, order: dict[tuple[str, str], dict[int, int]]):
    """UDF (field, text, sets of words) -> its forms ``of`` a value or name, letters from globally rare to frequent, and the keys it is found by.

    Of two whole forms at least two letters are the same (``_PAD`` is one), so the pairs among the
    first ``lacks`` + 2 letters have one in common; an abbreviated form is found by single letters.
    """

    def ordered(field: str, text: str, sets: tuple) -> list[dict]:
        found = []
        for sort, word, lacks in of(text, *(frozenset(s) if s is not None else _NONE for s in sets)):
            rank = order.get((field, sort), {})
            row = sorted(counted(word), key=lambda t: (rank.get(t, 0), t))
            if sort == "part":
                keys = row[: lacks + 1]
            else:
                row.append(_PAD)
                keys = [a << 32 | b for a, b in combinations(row[: lacks + 2], 2)]
            found.append({"sort": sort, "ordered": row, "keys": keys, "lacks": lacks})
        return found

    @F.pandas_udf(_FORMS)
    def forms(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for fields, texts, *sets in batches:
            yield pd.Series([ordered(f, t, s) for f, t, *s in zip(fields, texts, *sets)], dtype=object)

    return forms


@lru_cache(maxsize=50_000)
def _spelt(text: str, extra: frozenset, own: frozenset) -> tuple[str, list[tuple[str, frozenset]]]:
    return letters(text, extra, own), [(r, frozenset(tokens(r))) for r in readings(text, extra, own)]


def judge(value: str, name: str, extra: frozenset = _NONE, own: frozenset = _NONE, gone: frozenset = _NONE) -> tuple[float, float] | None:
    """Cost and negative set similarity of the nearest reading of a value and a listed name, or None if the value cannot mean it."""
    mine, read = _spelt(value, extra, own)
    aim, listed = _spelt(name, _NONE, _NONE)
    limit = allowed(len(aim))
    edits = osa(mine, aim, limit) if mine and aim else limit + 1
    found = []
    for (reading, a), (target, b) in product(read, listed):
        near = cost(reading, target, gone)
        if near is None and edits <= limit:
            near = float(edits)
        if near is not None:
            found.append((near, -(len(a & b) / len(a | b)) if a | b else 0.0))
    return min(found, default=None)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("cost", T.DoubleType()), T.StructField("unlike", T.DoubleType())])))
def _judged(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    """(value, name, extra, own, gone) -> one struct of cost and unlike, or none if the value cannot mean the name. An array, as the plan would evaluate a filtered struct twice."""
    for values, names, *sets in batches:
        found = [judge(v, n, *(frozenset(s) if s is not None else _NONE for s in three)) for v, n, *three in zip(values, names, *sets)]
        yield pd.Series([[{"cost": near[0], "unlike": near[1]}] if near else [] for near in found], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _skeletons(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in lists:
        yield pd.Series([[skeleton(w) for w in words] for words in series], dtype=object)


def _runs(c: Column) -> Column:
    """The words of a text: runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def decoration(values: DataFrame, listed: DataFrame, spread: int = SPREAD) -> DataFrame:
    """field, word, is_own: the words that stand in ``values`` beside the exact words of at least ``spread`` different entries, and whether some listed name has the word itself."""
    names = listed.select("field", "canon_id", F.array_distinct(_runs(F.col("name"))).alias("own")).where(F.size("own") > 0).withColumn("w", F.get("own", F.lit(0)))
    read = values.select("field", F.array_distinct(_runs(F.col("value"))).alias("read")).select("field", "read", F.explode("read").alias("w"))
    beside = read.join(names, ["field", "w"]).where((F.size("read") > F.size("own")) & (F.size(F.array_except("own", "read")) == 0))
    pairs = beside.select("field", "canon_id", F.explode(F.array_except("read", "own")).alias("word")).distinct()
    wide = pairs.groupBy("field", "word").agg(F.count("*").alias("n")).where(F.col("n") >= spread).select("field", "word")
    used = listed.select("field", F.explode(_runs(F.col("name"))).alias("word")).distinct().withColumn("is_own", F.lit(True))
    return wide.join(used, ["field", "word"], "left").select("field", "word", F.coalesce("is_own", F.lit(False)).alias("is_own"))


def omissions(values: DataFrame, listed: DataFrame) -> DataFrame:
    """field, name, gone: the words (skeletons) that a writer may leave out of a listed name of several words: those without which the rest, which no other entry has, is written more often than they are without the rest. Beside an abbreviated word the rest counts half."""
    full = F.array_join(_runs(F.regexp_replace(F.lower("value"), r"[\p{L}\p{N}]{1,3}\.", " ")), " ")
    keyed = values.select("field", full.alias("key"), F.when(full == F.array_join(_runs(F.col("value")), " "), 2).otherwise(1).alias("n"))
    bare = keyed.groupBy("field", "key").agg(F.sum("n").alias("n"))
    words = listed.select("field", "name", "canon_id", _runs(F.col("name")).alias("ws")).where(F.size("ws") > 1)
    each = words.select("field", "name", "canon_id", "ws", F.posexplode("ws").alias("i", "word"))
    rests = each.select("field", "name", "canon_id", "word", F.array_join(F.filter("ws", lambda w, i: i != F.col("i")), " ").alias("rest"))
    clear = rests.groupBy("field", "rest").agg(F.min("canon_id").alias("low"), F.max("canon_id").alias("high")).where(F.col("low") == F.col("high")).select("field", "rest")
    two = F.array(F.struct(F.col("rest").alias("key"), F.lit(1).alias("sign")), F.struct(F.col("word").alias("key"), F.lit(-1).alias("sign")))
    sides = rests.join(clear, ["field", "rest"]).select("field", "name", "word", F.explode(two).alias("s")).select("field", "name", "word", "s.*")
    left_out = sides.join(bare, ["field", "key"]).groupBy("field", "name", "word").agg(F.sum(F.col("n") * F.col("sign")).alias("lead")).where(F.col("lead") > 0)
    return left_out.groupBy("field", "name").agg(F.collect_set("word").alias("gone")).select("field", "name", _skeletons("gone").alias("gone"))


def map_values(values: DataFrame, canon: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The listed entry that each distinct ``(field, value)`` means: field, value, canon_id (-1 if none), cost, similarity.

    ``canon``: canon_id, field, canon_value, alt_name.

    What stands around names (law forms, kinds of wine, volumes) and which of their words may be
    left out is learnt from the table itself (``decoration``, ``omissions``).

    A join with prefix filter that finds every pair the edit check can take: the counted letters
    of a value's readings and of a listed name (whole, and without one word) are ordered by their
    rarity in the list. Names k edits apart lack at most k of each other's letters, so they share
    a pair among their k + 2 rarest; pairs of names are dropped by their lengths and common
    letters, counted once (at their first common key), and judged as a whole. A value with
    abbreviations has some letters of the name only, so its rarest are looked up among all of the
    name's. Of the pairs that can be the same name (and whose Jaccard similarity is at least
    ``threshold``) the one with the fewest edits, then the highest similarity stays. If two
    entries are equally near, the value means neither (-1).

    Null and blank values are not mapped; a null field has no entries, so its values get -1. An entry with a null name is left out, one with a null
    alternative has one name. With an empty list everything gets -1.
    """
    spark = values.sparkSession
    ship_package(spark)
    listed = canon.select("canon_id", "field", F.explode(F.array("canon_value", "alt_name")).alias("name")).where(F.length(F.trim("name")) > 0)
    # Distinct values are few bytes and much work, so they are dealt to all cores whatever their size.
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    values = cut(values.select("field", "value").where(F.col("field").isNotNull() & F.col("value").isNotNull()).repartition(parts, "field", "value"))
    around = decoration(values, listed)
    worn = (
        values.select("field", "value", F.explode(F.array_distinct(_runs(F.col("value")))).alias("word"))
        .join(around, ["field", "word"])
        .groupBy("field", "value")
        .agg(F.collect_list("word").alias("extra"), F.collect_list(F.when(F.col("is_own"), F.col("word"))).alias("own"))
    )
    # by number and another key, so that adaptive execution does not join these few bytes into one task
    values = values.join(worn, ["field", "value"], "left").repartition(parts, F.xxhash64("field", "value"))
    listed = listed.join(omissions(values, listed), ["field", "name"], "left")
    # The global order of the letters, some hundred counts a field and sort: they come to the driver.
    plain = listed.select("field", F.explode(_forms(name_forms, {})("field", "name", "gone")).alias("s")).select("field", "s.sort", F.explode("s.ordered").alias("t"))
    order: dict[tuple[str, str], dict[int, int]] = {}
    for row in plain.groupBy("field", "sort", "t").count().collect():
        order.setdefault((row.field, row.sort), {})[row.t] = row["count"]
    left = (
        values.select("*", F.explode(_forms(value_forms, order)("field", "value", "extra", "own")).alias("s"))
        .select("field", "value", "extra", "own", F.col("s.sort").alias("sort"), F.col("s.ordered").alias("ordered"), F.col("s.keys").alias("keys"), F.col("s.lacks").alias("lacks"))
        .select("*", F.explode("keys").alias("key"))
    )
    right = (
        listed.select("*", F.explode(_forms(name_forms, order)("field", "name", "gone")).alias("s"))
        .select(
            "field", "canon_id", "name", "gone", F.col("s.sort").alias("sort"), F.col("s.ordered").alias("ordered_y"), F.when(F.col("s.sort") == "part", F.transform("s.ordered", lambda t: t.cast("long"))).otherwise(F.col("s.keys")).alias("keys_y"), F.col("s.lacks").alias("lacks_y")
        )
        .select("*", F.explode("keys_y").alias("key"))
    )
    right = cut(right)
    if right.count() <= BROADCAST_KEYS:
        right = F.broadcast(right)
    common = F.size(F.array_intersect("ordered", "ordered_y"))
    least = F.greatest(F.size("ordered") - F.least("lacks", F.when(F.col("sort") == "part", F.col("lacks")).otherwise(F.col("lacks_y"))), F.size("ordered_y") - F.col("lacks_y"))
    pairs = (
        left.join(right, ["field", "sort", "key"])
        .where(F.least(F.size("ordered"), F.size("ordered_y")) >= least)
        .where(common >= least)
        .where(F.get(F.array_intersect("keys", "keys_y"), F.lit(0)) == F.col("key"))
        .select("field", "value", "canon_id", "name", "extra", "own", "gone")
        .repartition(parts, "field", "value")
        .dropDuplicates(["field", "value", "canon_id", "name"])
    )
    judged = pairs.select("field", "value", "canon_id", F.explode(_judged("value", "name", "extra", "own", "gone")).alias("near")).where(-F.col("near.unlike") >= threshold)
    per_entry = judged.groupBy("field", "value", "canon_id").agg(F.min("near").alias("near"))
    best = per_entry.groupBy("field", "value").agg(F.min("near").alias("near"), F.min_by("canon_id", "near").alias("canon_id"), F.collect_list("near").alias("all"))
    tied = F.size(F.filter("all", lambda x: x == F.col("near"))) > 1
    return best.select("field", "value", F.when(tied, F.lit(-1)).otherwise(F.col("canon_id")).cast("long").alias("canon_id"), "near.cost", (-F.col("near.unlike")).alias("similarity"))


def map_rows(rows: DataFrame, canon: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``rows``: src_table, src_id, field, value. One row per non-blank value that is not written as listed: src_table, src_id, field, value, canon_id.

    Each distinct value is mapped once, however many rows hold it, and joined back.
    """
    exact = canon.select("field", F.col("canon_value").alias("value")).where(F.col("value").isNotNull()).distinct()
    free = rows.where(F.col("value").rlike(r"(?U)\S")).join(exact, ["field", "value"], "left_anti")
    distinct = free.select("field", "value").distinct()
    mapped = map_values(distinct, canon, threshold).select("field", "value", "canon_id")
    return free.join(mapped, ["field", "value"], "left").select("src_table", "src_id", "field", "value", F.coalesce("canon_id", F.lit(-1).cast("long")).alias("canon_id"))
