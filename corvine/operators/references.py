"""References to records that do not exist, are gone, or came too late."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reference:
    """``key`` (an expression over ``df``, null where the row refers to nothing) must exist among the targets named ``target``."""

    table: str
    df: DataFrame
    ref_id: Column
    time: Column
    key: Column
    target: str


@dataclass(frozen=True)
class Target:
    """Rows that can be referred to. ``alive`` false means the row is deleted; null counts as alive."""

    name: str
    df: DataFrame
    key: Column
    seen_at: Column
    alive: Column


def _references(refs: list[Reference]) -> DataFrame:
    parts = [
        r.df.select(
            F.lit(r.table).alias("ref_table"), r.ref_id.cast("long").alias("ref_id"), r.time.alias("ref_time"), F.lit(r.target).alias("target"), r.key.alias("key")
        ).where(F.col("key").isNotNull())
        for r in refs
    ]
    return reduce(DataFrame.unionByName, parts)


def _target_keys(targets: list[Target]) -> DataFrame:
    parts = [
        t.df.select(F.lit(t.name).alias("target"), t.key.alias("key"), t.seen_at.alias("seen_at"), F.coalesce(t.alive, F.lit(True)).alias("alive")).where(
            F.col("key").isNotNull()
        )
        for t in targets
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("target", "key").agg(F.min("seen_at").alias("first_seen"), F.max("alive").alias("any_alive"))


def resolve_references(refs: list[Reference], targets: list[Target]) -> DataFrame:
    """Every reference with its ``state``: ``missing``, ``deleted``, ``late`` or null (valid).

    The distinct foreign keys are anti-joined with the distinct target keys, so the heavy
    comparison moves one row a key; the missing keys and the known ones are then joined back to
    the references. A key that a third of all rows share is one row on the distinct side; on the
    join back adaptive execution splits its partition.

    A reference whose key is null refers to nothing and is left out. An empty target table makes
    every reference ``missing``; a null time (of either side) is never ``late``. Repeated rows
    are kept. Only the columns named are read, so further columns may have any name.
    """
    refs_df = _references(refs)
    known = _target_keys(targets)
    wanted = refs_df.select("target", "key").distinct()
    missing = wanted.join(known.select("target", "key"), ["target", "key"], "left_anti")
    states = known.withColumn("missing", F.lit(False)).unionByName(
        missing.select("target", "key", F.lit(None).cast(known.schema["first_seen"].dataType).alias("first_seen"), F.lit(None).cast("boolean").alias("any_alive"), F.lit(True).alias("missing"))
    )
    state = F.when(F.col("missing"), "missing").when(~F.col("any_alive"), "deleted").when(F.col("first_seen") > F.col("ref_time"), "late")
    return refs_df.join(states, ["target", "key"]).select(
        "ref_table", F.date_format("ref_time", "yyyy-MM").alias("period"), "ref_id", "target", "key", state.alias("state")
    )


def orphan_references(refs: list[Reference], targets: list[Target]) -> DataFrame:
    """One row per reference without a valid target: ref_table, period, ref_id, state."""
    return resolve_references(refs, targets).where(F.col("state").isNotNull()).select("ref_table", "period", "ref_id", "state")


def orphans_by_period(refs: list[Reference], targets: list[Target]) -> DataFrame:
    """References, and those missing, deleted and late, per table and month."""
    return (
        resolve_references(refs, targets)
        .groupBy("ref_table", "period")
        .agg(F.count("*").alias("n_refs"), *(F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("missing", "deleted", "late")))
    )
