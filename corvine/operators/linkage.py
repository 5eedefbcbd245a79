"""Record linkage of items and media files in three tiers, and the review marks that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvine.functions.text import media_stem
from corvine.functions.tokens import FUZZY_MIN, latin
from corvine.operators.search import similar_words
from corvine.operators.sequences import assign_once
from corvine.session import cut

# Words that say nothing, least similarity of a pair of words and of a pair of records, least score beyond suspicion.
GENERIC = ("beloe", "butylka", "etiketka", "foto", "igristoe", "krasnoe", "normal", "photo", "preview", "rozovoe", "suhoe", "vino", "wine", "winery")
WORD_MATCH, PAIR_MATCH, CLEAR_MATCH = 0.82, 0.72, 0.85


def record_words(c: Column) -> Column:
    """Distinct Latin words of three letters or more that are no numbers and not generic."""
    return F.array_distinct(F.filter(F.regexp_extract_all(latin(c), F.lit("[a-zа-яё0-9]+"), F.lit(0)), lambda t: (F.length(t) >= 3) & ~t.rlike(r"\A\d+\z") & ~t.isin(*GENERIC)))


def fuzzy_pairs(items: DataFrame, media: DataFrame, links: DataFrame | None) -> DataFrame:
    """left, right, score of pairs that share an equal word and score ``PAIR_MATCH`` or more.

    ``items``: left, token; ``media``: right, token (both distinct); ``links``: token (of an item),
    query (of a medium), similarity of different words. Each word of the medium counts with the most similar word of
    the item; score = 0.8 x their sum / words of the medium + 0.2 x their sum / words of the item.
    """
    # a pair needs an equal word; what its words add up to is then asked of these pairs only
    pairs = items.join(media, "token").select("left", "right").distinct()
    n_left = items.groupBy("left").agg(F.count("*").alias("n_left"))
    n_right = media.groupBy("right").agg(F.count("*").alias("n_right"))
    wide = pairs.join(n_left, "left").join(n_right, "right")
    linked = items.select("token").distinct().select("token", F.col("token").alias("query"), F.lit(1.0).alias("similarity"))
    if links is not None:
        linked = linked.unionByName(links.select("token", "query", "similarity"))
    left_words = wide.join(items, "left").select("left", "right", "n_left", "n_right", "token")
    reached = left_words.join(linked, "token").select("left", "right", "n_left", "n_right", "query", "similarity")
    best = reached.join(media.withColumnRenamed("token", "query"), ["right", "query"]).groupBy("left", "right", "n_left", "n_right", "query").agg(F.max("similarity").alias("s"))
    total = best.groupBy("left", "right", "n_left", "n_right").agg(F.sum("s").alias("m"))
    score = F.round(0.8 * F.col("m") / F.col("n_right") + 0.2 * F.col("m") / F.col("n_left"), 6)
    return total.select("left", "right", score.alias("score")).where(F.col("score") >= PAIR_MATCH)


def link(items: DataFrame, media: DataFrame, fuzzy: bool = True) -> DataFrame:
    """item, image, path, mapping_kind, mapping_score of each item that has a picture.

    ``items``: item, name_key, item_key (normalised file name and own key), text; ``media``: path,
    filename, image, key, width, height, size.

    1. the file name, 2. the item's key lead to the best file of the same key (portrait, then
    largest, then last path). 3. Items without either, in order, take the picture not used yet
    with the highest pair score, each picture once; a picture goes by its first file. Files with
    the same words are one candidate with as many places, so that a frequent word does not make
    pairs of all files; of equal scores the candidate whose words come first is taken, and of its
    files the next path.
    """
    best = media.where(F.col("key").isNotNull()).groupBy("key").agg(F.max_by(F.struct("image", "path"), F.struct((F.col("height") > F.col("width")).alias("portrait"), "size", "path")).alias("p"))
    joined = items.join(best.select(F.col("key").alias("name_key"), F.col("p").alias("a")), "name_key", "left").join(best.select(F.col("key").alias("item_key"), F.col("p").alias("b")), "item_key", "left")
    exact = cut(joined.select("item", "text", F.coalesce("a", "b").alias("p"), F.when(F.col("a").isNotNull(), "image_filename").when(F.col("b").isNotNull(), "slug").alias("mapping_kind")))
    found = exact.where(F.col("p").isNotNull()).select("item", "p.image", "p.path", "mapping_kind", F.lit(1.0).alias("mapping_score"))
    used = found.select("image").distinct()
    first = media.join(used, "image", "left_anti").groupBy("image").agg(F.min(F.struct("path", "filename")).alias("f"))
    free = cut(first.select("image", "f.path", F.array_sort(record_words(media_stem(F.col("f.filename")))).alias("words")).where(F.size("words") > 0).withColumn("right", F.array_join("words", " ")))
    room = free.groupBy("right").agg(F.count("*").cast("int").alias("room"))
    right = free.select("right", "words").distinct().select("right", F.explode("words").alias("token"))
    open_ = cut(exact.where(F.col("p").isNull()).select(F.col("item").alias("left"), F.explode(record_words(F.col("text"))).alias("token")))
    chosen = assign_once(fuzzy_pairs(open_, right, similar_words(open_.select("token"), right.select("token"), WORD_MATCH, FUZZY_MIN) if fuzzy else None), room)
    files = free.select("right", "image", "path", F.row_number().over(Window.partitionBy("right").orderBy("path")).alias("place"))
    third = chosen.join(files, ["right", "place"]).select(F.col("left").alias("item"), "image", "path", F.lit("fuzzy_filename").alias("mapping_kind"), F.col("score").alias("mapping_score"))
    return found.unionByName(third)


def mark_suspicious(mappings: DataFrame) -> DataFrame:
    """Adds ``review_status``: suspicious if another item has the same picture or a fuzzy match is not clear, else auto."""
    shared = mappings.groupBy("image").agg(F.count_distinct("item").alias("n")).where("n > 1").select("image", F.lit(True).alias("is_shared"))
    unclear = (F.col("mapping_kind") == "fuzzy_filename") & (F.col("mapping_score") < CLEAR_MATCH)
    return mappings.join(shared, "image", "left").withColumn("review_status", F.when(F.coalesce("is_shared", F.lit(False)) | unclear, "suspicious").otherwise("auto")).drop("is_shared")


def displace(mappings: DataFrame, overrides: DataFrame, media: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mappings after manual corrections, and the issues they raise.

    ``overrides``: line_no, item, action, filename, one an item (the first line counts);
    ``media``: filename, path, image. reject takes the picture away, confirm marks it, set gives
    the picture of a file name that leads to exactly one; other items that hold it lose it
    (issue ``displaced``, with the line that took it). A name that leads to none or several
    pictures, and a confirmation without a picture, change nothing (issues ``unknown_file``,
    ``ambiguous_file``, ``nothing_to_confirm``). Of several lines that take one picture the last one keeps it.
    """
    first = overrides.groupBy("item").agg(F.min(F.struct("line_no", "action", "filename")).alias("o")).select("item", "o.*")
    files = media.groupBy("filename").agg(F.count_distinct("image").alias("n"), F.min(F.struct("path", "image")).alias("p"))
    sets = first.where("action = 'set'").join(files, "filename", "left")
    good = sets.where("n = 1").select("item", "line_no", "p.image", "p.path")
    taken = good.groupBy("image").agg(F.max("line_no").alias("line_no"), F.max_by("item", "line_no").alias("owner"))
    keep = good.join(taken, ["image", "line_no"]).select("item", "image", "path", F.lit("override").alias("mapping_kind"), F.lit(1.0).alias("mapping_score"), F.lit("confirmed").alias("review_status"))
    other = mappings.join(first.select("item", "action"), "item", "left").join(good.select("item", F.lit(True).alias("is_set")), "item", "left")
    rest = other.where(~F.coalesce(F.col("action") == "reject", F.lit(False)) & F.col("is_set").isNull())
    held = rest.join(taken.select("image", F.col("line_no").alias("by_line"), "owner"), "image", "left")
    stay = held.where(F.col("by_line").isNull()).select("item", "image", "path", "mapping_kind", "mapping_score", F.when(F.col("action") == "confirm", "confirmed").otherwise(F.col("review_status")).alias("review_status"))
    lost = held.where(F.col("by_line").isNotNull()).select(F.lit("displaced").alias("kind"), "item", F.col("by_line").alias("line_no"))
    later = good.join(taken.select("image", F.col("line_no").alias("by_line")), "image").where(F.col("line_no") < F.col("by_line")).select(F.lit("displaced").alias("kind"), "item", F.col("by_line").alias("line_no"))
    wrong = sets.where(F.col("n").isNull() | (F.col("n") > 1)).select(F.when(F.col("n").isNull(), "unknown_file").otherwise("ambiguous_file").alias("kind"), "item", "line_no")
    blank = first.where("action = 'confirm'").join(mappings.select("item"), "item", "left_anti").select(F.lit("nothing_to_confirm").alias("kind"), "item", "line_no")
    return stay.unionByName(keep), lost.unionByName(later).unionByName(wrong).unionByName(blank)
