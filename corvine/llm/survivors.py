"""One surviving record of each group of duplicates, field by field."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.functions.text import clean, is_real, slug_key
from corvine.operators.packed import packed_values
from corvine.session import cut

FIELDS = ("name", "category", "color", "region", "grape_varieties", "description", "winery", "source_image_filename")
MULTI_VALUED = frozenset({"grape_varieties"})
#: Probability from which a value is judged true.
KEEP = 0.5
#: 3 ** MAX_SOURCES patterns at most come to the driver.
MAX_SOURCES = 10


def fit_sources(patterns: list[tuple[int, int, int]], n_sources: int, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation of the two-sided source model.

    ``patterns``: (claim mask, cover mask, number of facts). A source covers a fact if it says
    anything about that field of that group, and claims it if it gives that value. Returns each
    source's sensitivity (share of true values it gives) and specificity (share of false values
    it does not give) and the probability that the facts of each pattern are true.
    """
    claim = np.array([[p[0] >> s & 1 for s in range(n_sources)] for p in patterns], dtype=float).reshape(len(patterns), n_sources)
    cover = np.array([[p[1] >> s & 1 for s in range(n_sources)] for p in patterns], dtype=float).reshape(len(patterns), n_sources)
    weight = np.array([p[2] for p in patterns], dtype=float)
    sensitivity, specificity, prior = np.full(n_sources, 0.7), np.full(n_sources, 0.8), 0.5
    truth = np.full(len(patterns), 0.5)
    for _ in range(rounds):
        yes = np.log(prior) + cover @ np.log(1 - sensitivity) + claim @ (np.log(sensitivity) - np.log(1 - sensitivity))
        no = np.log(1 - prior) + cover @ np.log(specificity) + claim @ (np.log(1 - specificity) - np.log(specificity))
        truth = 1 / (1 + np.exp(np.clip(no - yes, -500, 500)))
        t, f = weight * truth, weight * (1 - truth)
        # Beta priors keep the two sides apart: sources are right more often than not.
        sensitivity = np.clip((t @ claim + 7) / (t @ cover + 10), 1e-3, 1 - 1e-3)
        specificity = np.clip((f @ (cover - claim) + 9) / (f @ cover + 10), 1e-3, 1 - 1e-3)
        prior = float(np.clip((t.sum() + 1) / (weight.sum() + 2), 1e-3, 1 - 1e-3))
    return sensitivity, specificity, truth


def _indexed(df: DataFrame, feeds: DataFrame) -> tuple[DataFrame, list]:
    """Adds ``trust`` and ``bit`` of the row's feed. A null feed, and one that is not listed, have no trust and share the last bit."""
    known = feeds.where(F.col("feed").isNotNull()).groupBy("feed").agg(F.max("trust").alias("trust")).orderBy("feed").limit(MAX_SOURCES + 1).collect()
    if len(known) >= MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES - 1} sources")
    names = [row.feed for row in known] + [None]
    trust, bit = F.lit(None).cast("int"), F.lit(1 << len(known)).cast("long")
    for i, row in enumerate(known):
        trust = F.when(F.col("feed") == row.feed, F.lit(row.trust)).otherwise(trust)
        bit = F.when(F.col("feed") == row.feed, F.lit(1 << i).cast("long")).otherwise(bit)
    return df.withColumn("trust", trust).withColumn("bit", bit), names


class Survivors:
    """The model over one table of duplicates.

    ``rows``: row_id, slug, feed, loaded_at, raw_record_count, source_row_no and the fields; ``feeds``: feed, trust.

    Groups are the rows with the same slug (case, blanks and separators aside), two or more; a
    blank slug belongs to no group. A null, blank or filler field is no claim. A group or field
    without any real value gives no row. Repeated rows count as rows. All aggregates are combined
    before the shuffle, so a group with a third of the rows is one row a partition.
    """

    def __init__(self, rows: DataFrame, feeds: DataFrame, fields: tuple[str, ...] = FIELDS):
        self.fields = fields
        keyed = rows.select(slug_key(F.col("slug")).alias("slug"), "row_id", "feed", "loaded_at", "raw_record_count", "source_row_no", *fields)
        self.rows, self.sources = _indexed(keyed.where(F.col("slug").isNotNull()), feeds)

    def facts(self) -> DataFrame:
        """slug, field, value, claim: the distinct real values of each group and the set of sources (bits) that give them."""
        # a slug with one row says nothing about agreement
        many_rows = self.rows.groupBy("slug").agg(F.count("*").alias("n")).where(F.col("n") >= 2).select("slug")
        packed = self.rows.join(many_rows, "slug", "left_semi").select("*", *(packed_values(F.col(f)).alias(f"__packed_{f}") for f in self.fields if f in MULTI_VALUED))
        values = []
        for field in self.fields:
            one = F.array(F.lower(clean(F.col(field))))
            if field in MULTI_VALUED:
                many = F.col(f"__packed_{field}")
                one = F.when(F.size(many) > 0, F.transform(many, F.lower)).otherwise(one)
            values.append(F.struct(F.lit(field).alias("field"), F.when(is_real(F.col(field)), one).alias("vs")))
        long = packed.select("slug", "bit", F.explode(F.array(*values)).alias("f")).select("slug", "bit", "f.field", F.explode("f.vs").alias("value"))
        return long.groupBy("slug", "field", "value").agg(F.bit_or("bit").alias("claim"))

    def _fit(self, patterns: DataFrame) -> DataFrame:
        """Fits the sources to ``patterns`` (claim, cover, n; at most 3 to the number of sources rows) and returns claim, cover, truth."""
        found = sorted((r.claim, r.cover, r.n) for r in patterns.collect())
        self.sensitivity, self.specificity, truth = fit_sources(found, len(self.sources))
        rows = [(p[0], p[1], float(t)) for p, t in zip(found, truth)]
        return patterns.sparkSession.createDataFrame(rows, "claim long, cover long, truth double")

    def candidates(self) -> DataFrame:
        """group_row_id, field, cover, claims (how many values each set of sources gives, at most 2 to the number of sources entries), best (the first row, by the declared order, that gives any of them).

        A value is 64 bits of its hash here. Rows meet their group with hashes instead of texts; the
        facts are combined before they move, so that a large group is spread over its fields and values.
        """
        plain, many = [f for f in self.fields if f not in MULTI_VALUED], [f for f in self.fields if f in MULTI_VALUED]
        hashes = [F.when(is_real(F.col(f)), F.xxhash64(F.lower(clean(F.col(f))))).alias(f) for f in plain]
        groups = self.rows.groupBy("slug").agg(F.min("row_id").alias("group_row_id"), F.count("*").alias("n")).where(F.col("n") >= 2).select("slug", "group_row_id")
        # packed values are only taken apart in rows that have a group
        met = self.rows.select("slug", "bit", self._order().alias("place"), *hashes, *many).join(groups, "slug")
        split = met.select("group_row_id", "bit", "place", *plain, *many, *(packed_values(F.col(f)).alias(f"__packed_{f}") for f in many))
        own = {f: F.array(F.col(f)) for f in plain}
        for f in many:
            parts = F.col(f"__packed_{f}")
            own[f] = F.when(is_real(F.col(f)), F.when(F.size(parts) > 0, F.transform(parts, lambda v: F.xxhash64(F.lower(v)))).otherwise(F.array(F.xxhash64(F.lower(clean(F.col(f)))))))
        met = split.select("group_row_id", "bit", "place", F.posexplode(F.array(*(own[f] for f in self.fields))).alias("f", "vs")).select("group_row_id", "bit", "place", "f", F.explode("vs").alias("value")).where(F.col("value").isNotNull())
        facts = met.select("group_row_id", F.col("f").cast("byte").alias("f"), "value", "bit", "place").groupBy("group_row_id", "f", "value").agg(F.bit_or("bit").alias("claim"), F.max("place").alias("place"))
        sets = facts.groupBy("group_row_id", "f", "claim").agg(F.count("*").alias("n"), F.max("place").alias("place"))
        names = F.array(*map(F.lit, self.fields))
        return (
            sets.groupBy("group_row_id", "f")
            .agg(F.bit_or("claim").alias("cover"), F.collect_list(F.struct("claim", "n")).alias("claims"), F.max("place").alias("best"))
            .select("group_row_id", F.get(names, F.col("f").cast("int")).alias("field"), "cover", "claims", (-F.col("best.last")).alias("best_row_id"))
        )

    def judged(self) -> DataFrame:
        """Facts with ``cover``, ``truth`` (probability) and ``kept``: every value judged true, one or several a field."""
        facts = self.facts()
        joined = facts.join(facts.groupBy("slug", "field").agg(F.bit_or("claim").alias("cover")), ["slug", "field"])
        truth = self._fit(joined.groupBy("claim", "cover").agg(F.count("*").alias("n")))
        return joined.join(truth, ["claim", "cover"]).select("slug", "field", "value", "claim", "cover", "truth", (F.col("truth") >= KEEP).alias("kept"))

    def _order(self) -> Column:
        """Trust, then latest load, most records, first row number, first row id; nulls are least, as null structs fields sort first."""
        return F.struct(F.col("trust"), F.col("loaded_at"), F.coalesce("raw_record_count", F.lit(0)).alias("count"), (-F.col("source_row_no").cast("long")).alias("no"), (-F.col("row_id")).alias("last"))

    def records(self) -> DataFrame:
        """group_row_id, field, best_row_id, n_values, n_kept, truth: what survives of each field.

        The candidates of a field are the values that the model judges, with how likely each is;
        of the rows that give one of them the declared order names the one that speaks for the field.
        """
        judged = cut(self.candidates())
        flat = judged.select("group_row_id", "field", "cover", "best_row_id", F.inline("claims").alias("claim", "n"))
        truth = self._fit(flat.groupBy("claim", "cover").agg(F.sum("n").alias("n")))
        kept = F.sum(F.when(F.col("truth") >= KEEP, F.col("n")).otherwise(0)).alias("n_kept")
        return (
            flat.join(truth, ["claim", "cover"])
            .groupBy("group_row_id", "field", "best_row_id")
            .agg(F.sum("n").alias("n_values"), kept, F.round(F.max("truth"), 6).alias("truth"))
        )

    def values(self) -> DataFrame:
        """group_row_id, field, value, truth, kept of each value in a group of two or more rows."""
        groups = self.rows.groupBy("slug").agg(F.min("row_id").alias("group_row_id"), F.count("*").alias("n_rows")).where(F.col("n_rows") >= 2)
        return self.judged().join(groups, "slug").select("group_row_id", "field", "value", F.round("truth", 6).alias("truth"), "kept")

    def source_quality(self) -> DataFrame:
        """feed (null for none), sensitivity, specificity and the facts that the feed covers."""
        judged = self.judged()
        counts = judged.agg(*(F.count_if(F.col("cover").bitwiseAND(F.lit(1 << i)) != 0).alias(f"n{i}") for i in range(len(self.sources))))
        rows = [
            F.struct(F.lit(name).cast("string").alias("feed"), F.lit(round(float(self.sensitivity[i]), 6)).alias("sensitivity"), F.lit(round(float(self.specificity[i]), 6)).alias("specificity"), F.col(f"n{i}").alias("n_facts"))
            for i, name in enumerate(self.sources)
        ]
        return counts.select(F.inline(F.array(*rows)))
