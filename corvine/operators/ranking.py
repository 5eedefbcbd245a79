"""Evidence of several readings fused into one decision for each scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvine.session import cut

# Weight of each kind of evidence, softmax temperature, least margin.
WEIGHTS = {"slug": 0.70, "name": 0.20, "winery": 0.20, "grape_varieties": 0.12, "year": 0.08, "region": 0.04, "category": 0.03}
TOTAL = 1.37
TEMPERATURE = 0.06
MIN_MARGIN = 0.03
#: Readings of further fields that go along with each proposal of a scan; scans with more are joined with theirs.
CARRIED = 64


def distribution(candidates: DataFrame, by: list[str], temperature: float = TEMPERATURE) -> DataFrame:
    """Softmax of the best score of each value within ``by``: by, value, share.

    Values are made distinct first: a scan with a tenth of all rows is combined before the shuffle, and its window holds each value once.
    """
    best = candidates.where(F.col("value").isNotNull() & F.col("score").isNotNull()).groupBy(*by, "value").agg(F.max("score").alias("score"))
    group = Window.partitionBy(*by)
    weighed = best.withColumn("e", F.exp((F.col("score") - F.max("score").over(group)) / temperature))
    return weighed.withColumn("total", F.sum("e").over(group)).select(*by, "value", F.round(F.col("e") / F.col("total"), 6).alias("share"))


def only_value(candidates: DataFrame, by: list[str]) -> DataFrame:
    """The value of each group that has exactly one."""
    return candidates.where(F.col("value").isNotNull()).groupBy(*by).agg(F.min("value").alias("value"), F.max("value").alias("__high")).where(F.col("value") == F.col("__high")).drop("__high")


def proposals(shares: DataFrame, known: DataFrame, scan: str, anchors: tuple[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """scan, a, b, share_a, share_b, columns ``keep`` of known: the pairs of ``known`` (a, b; distinct) of which a scan reads both sides.

    A reading of ``a`` meets the readings of ``b`` of its scan or the partners of its value, whichever
    are fewer: neither a scan with many readings nor a value with many partners is multiplied by the other.
    """
    a, b = anchors
    side = lambda f: shares.where(F.col("field") == f).select(scan, F.col("value").alias(f), F.col("share").alias(f"share_{f}"))
    others = side(b).join(known.select(b).distinct(), b, "left_semi")
    sizes = known.groupBy(a).agg(F.count("*").alias("__partners"))
    ones = side(a).join(sizes, a).join(others.groupBy(scan).agg(F.count("*").alias("__readings")), scan)
    many = F.col("__readings") > F.col("__partners")
    by_scan = ones.where(~many).select(scan, a, f"share_{a}").join(others, scan).join(known, [a, b])
    by_value = ones.where(many).select(scan, a, f"share_{a}").join(known, a).join(others, [scan, b])
    columns = [scan, a, b, f"share_{a}", f"share_{b}", *keep]
    return by_scan.select(*columns).unionByName(by_value.select(*columns))


def carried_shares(shares: DataFrame, scan: str, fields: tuple[str, ...]) -> DataFrame:
    """scan, is_heavy, a map share_f (value to share) for each field: of scans with up to ``CARRIED`` readings of these fields their maps, of others ``is_heavy`` alone."""
    near = shares.where(F.col("field").isin(*fields))
    heavy = near.groupBy(scan).agg(F.count("*").alias("__n")).where(F.col("__n") > CARRIED).select(scan)
    entry = lambda f: F.when(F.col("field") == f, F.struct("value", "share"))
    maps = near.join(heavy, scan, "left_anti").groupBy(scan).agg(*(F.map_from_entries(F.collect_list(entry(f))).alias(f"share_{f}") for f in fields))
    return maps.withColumn("is_heavy", F.lit(False)).unionByName(heavy.withColumn("is_heavy", F.lit(True)), allowMissingColumns=True)


def most_shares(shares: DataFrame, scan: str, fields: tuple[str, ...]) -> DataFrame:
    """scan, most: the largest weighted sum that the shares of ``fields`` can add to an item."""
    top = lambda f: WEIGHTS[f] * F.coalesce(F.max(F.when(F.col("field") == f, F.col("share"))), F.lit(0.0))
    return shares.where(F.col("field").isin(*fields)).groupBy(scan).agg(reduce(lambda x, y: x + y, map(top, fields)).alias("most"))


def leading(pairs: DataFrame, by: list[str], base: Column, most: Column, n_items: str, first: int) -> DataFrame:
    """The pairs that can hold one of the first ``first`` items by evidence within ``by``.

    Every item of a pair has the weighted sum ``base`` at least and ``most`` more at most. The pairs
    with the largest bases that have ``first`` items together set a floor: what cannot reach the
    least of their bases is behind all of these items. The floor is lowered by more than the rounding of evidence.
    """
    so_far = Window.partitionBy(*by).orderBy(F.desc("__base")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = pairs.withColumn("__base", base).withColumn("__so_far", F.sum(n_items).over(so_far))
    floor = F.max(F.when(F.col("__so_far") >= first, F.col("__base"))).over(Window.partitionBy(*by))
    reached = F.coalesce(F.col("__base") + most >= F.col("__floor") - 0.001, F.lit(True))
    return summed.withColumn("__floor", floor).where(reached).drop("__base", "__so_far", "__floor")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Few rows that become many when they are joined by ``by``: in as many tasks as there are partitions, so that what a task sorts stays small."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def evidence(shares: DataFrame, items: DataFrame, scan: str, item: str, anchors: tuple[str, str] = ("winery", "name"), extra: tuple[str, ...] = ("region", "category"), facts: DataFrame | None = None, keep: tuple[str, ...] = (), first: int | None = None) -> DataFrame:
    """scan, item, evidence (weighted shares over the constant total), is_named, columns ``keep`` of items and facts.

    ``shares``: scan, field, value, share (each value once); ``items``: item (once) and one column a
    field; ``facts``: scan (once) and what is known of it. Items are proposed by both selective fields
    together (an equi-join, never scans x items); the other fields only add to what was proposed.

    Common pairs have many items and are read by many scans, so the rows of the result grow faster than
    either side. Everything known of a scan is therefore joined to its pairs; their items come last,
    and the rows are not shuffled once they are there. Only scans with more than ``CARRIED``
    readings of the other fields are joined with them row by row.
    ``first``: only the first so many items of each scan by evidence are asked for; pairs that cannot hold one of them are left out.
    """
    a, b = anchors
    known = items.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    if first is None:
        proposed = proposals(shares, known.select(a, b).distinct(), scan, anchors)
    else:
        sizes = known.groupBy(a, b).agg(F.count("*").alias("n_items"))
        proposed = proposals(shares, sizes, scan, anchors, ("n_items",)).join(most_shares(shares, scan, extra), scan, "left")
        base = WEIGHTS[a] * F.col(f"share_{a}") + WEIGHTS[b] * F.col(f"share_{b}")
        # few are left: written once, and what was shuffled to find them is deleted
        proposed = cut(leading(proposed, [scan], base, F.coalesce("most", F.lit(0.0)), "n_items", first).drop("n_items", "most"))
    if facts is not None:
        proposed = proposed.join(facts, scan, "left")
    about = proposed.join(carried_shares(shares, scan, extra), scan, "left")
    if first is not None:
        about = spread(about, a, b)
    light = about.where(~F.coalesce("is_heavy", F.lit(False))).join(known, [a, b])
    rows = about.where("is_heavy").drop(*(f"share_{f}" for f in extra)).join(known, [a, b])
    for f in extra:
        rows = rows.join(shares.where(F.col("field") == f).select(scan, F.col("value").alias(f), F.col("share").alias(f"share_{f}")), [scan, f], "left")

    def scored(df: DataFrame, share) -> DataFrame:
        parts = [WEIGHTS[f] * F.col(f"share_{f}") for f in (a, b)] + [WEIGHTS[f] * F.coalesce(share(f), F.lit(0.0)) for f in extra]
        return df.select(scan, item, F.round(reduce(lambda x, y: x + y, parts) / TOTAL, 4).alias("evidence"), (F.col(f"share_{b}") > 0).alias("is_named"), *keep)

    return scored(light, lambda f: F.try_element_at(f"share_{f}", F.col(f))).unionByName(scored(rows, lambda f: F.col(f"share_{f}")))


def ranked(df: DataFrame, scan: str, item: str, rejected: Column, limit: int) -> DataFrame:
    """The first ``limit`` of each scan by (rejected, evidence descending, item)."""
    order = Window.partitionBy(scan).orderBy(rejected, F.desc("evidence"), item)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def decide(top: DataFrame, scan: str, item: str) -> DataFrame:
    """Winner, margin over the best rival and status of each scan; ``top``: scan, item, evidence, kind, rank.

    The winner is the best item that nothing contradicts, else the best of all. A contradicted
    item is no rival. Without a rival the margin is the score; if every item is contradicted, nothing is found.
    """
    fine = F.col("kind").isNull()
    w = top.groupBy(scan).agg(
        F.coalesce(F.min_by(F.when(fine, F.col(item)), F.when(fine, F.col("rank"))), F.min_by(item, "rank")).alias("winner"),
        F.coalesce(F.max(F.when(fine, F.col("evidence"))), F.max("evidence")).alias("score"),
        F.count_if(fine).alias("n_fine"),
        F.sort_array(F.collect_list(F.when(fine, F.col("evidence"))), asc=False).alias("__scores"),
    )
    margin = F.round(F.col("score") - F.coalesce(F.get("__scores", F.lit(1)), F.lit(0.0)), 4)
    status = F.when((F.col("n_fine") > 0) & (margin >= MIN_MARGIN), "matched").otherwise("not_found")
    return w.select(scan, "winner", "score", margin.alias("margin"), status.alias("status"))


def contributions(df: DataFrame, by: list[str], amount: Column) -> DataFrame:
    """Share of each positive amount in its group's sum."""
    kept = df.withColumn("__amount", amount).where(F.col("__amount") > 0)
    total = kept.groupBy(*by).agg(F.sum("__amount").alias("__total"))
    return kept.join(total, by).withColumn("part", F.round(F.col("__amount") / F.col("__total"), 6)).drop("__amount", "__total")


def seen_tokens(names: DataFrame, label: DataFrame, links: DataFrame, scan: str, item: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """scan, item, token, columns ``keep`` of names, seen: which words of each shortlisted name the label shows.

    ``names``: scan, item, token; ``label``: scan, query (read words); ``links``: token, query,
    similarity. A read word supports only the shortlisted words that it matches best (all of equal ones).
    """
    wanted = names.select(scan, "token").distinct()
    # links to words of no shortlisted name are left out before they meet the labels
    links = links.join(wanted.select("token").distinct(), "token", "left_semi")
    near = label.join(links, "query").join(wanted, [scan, "token"]).select(scan, "query", "token", "similarity")
    best = near.withColumn("top", F.max("similarity").over(Window.partitionBy(scan, "query")))
    shown = best.where(F.col("similarity") == F.col("top")).select(scan, "token", F.lit(True).alias("seen")).distinct()
    return names.join(shown, [scan, "token"], "left").select(scan, item, "token", *keep, F.coalesce("seen", F.lit(False)).alias("seen"))


def name_checks(seen: DataFrame, scan: str, item: str, number: str | None = None) -> DataFrame:
    """scan, item, is_fully_read, n_against: names whose words are all shown, and by how many shortlisted rivals each name is contradicted.

    ``number``: column of ``seen``, how many rivals an item stands for (else one).

    A rival contradicts a name if the label shows a word of the rival that the name lacks, and no
    word of the name that the rival lacks. Rivals meet inside a shortlist, whose length the caller has bounded.
    """
    full = seen.groupBy(scan, item).agg(F.min("seen").alias("is_fully_read"), F.sort_array(F.collect_set("token")).alias("own"), F.collect_set(F.when(F.col("seen"), F.col("token"))).alias("shown"), (F.max(number) if number else F.lit(1).cast("long")).alias("n"))
    # read three times below: written once
    full = cut(full)
    # rivals with the same words are met once, with their number
    sets = full.groupBy(scan, "own", F.array_sort("shown").alias("shown")).agg(F.sum("n").alias("n"))
    rival = sets.select(scan, F.col("own").alias("__own"), F.col("shown").alias("__shown"), "n")
    against = (
        sets.drop("n").join(rival, scan)
        .where((F.size(F.array_except("__shown", "own")) > 0) & (F.size(F.array_except("shown", "__own")) == 0))
        .groupBy(scan, "own", "shown")
        .agg(F.sum("n").alias("n_against"))
    )
    return full.withColumn("shown", F.array_sort("shown")).join(against, [scan, "own", "shown"], "left").select(scan, item, "is_fully_read", F.coalesce("n_against", F.lit(0).cast("long")).alias("n_against"))


def identified(checks: DataFrame, least_visual: float = 0.25) -> DataFrame:
    """Adds ``is_identified``: a clear visual share identifies; a faint one only with the name; the name alone only if it is fully read. Needs visual, name_share, is_fully_read."""
    visual, name = F.coalesce("visual", F.lit(0.0)), F.coalesce("name_share", F.lit(0.0))
    return checks.withColumn("is_identified", (visual >= least_visual) | ((visual > 0) & (name > 0)) | ((name > 0) & F.coalesce("is_fully_read", F.lit(True))))


def grapes_fit(spelt: Column, own: Column) -> Column:
    """Whether every word of at least one spelt-out grape (array of arrays) is among the item's own words; true if none is spelt out."""
    return (F.size(spelt) == 0) | F.exists(spelt, lambda grape: F.size(F.array_except(grape, own)) == 0)


def spelt_out(read: DataFrame, label: DataFrame, scan: str, value: str) -> DataFrame:
    """scan, value, needed of the readings whose words (array ``needed``, at least one) all stand on the scan's label. ``label``: scan, word (distinct)."""
    asked = read.select(scan, value, "needed").distinct()
    found = asked.select(scan, value, F.explode("needed").alias("word")).join(label, [scan, "word"]).groupBy(scan, value).agg(F.count("*").alias("__n"))
    return asked.join(found, [scan, value]).where(F.col("__n") == F.size("needed")).select(scan, value, "needed")
