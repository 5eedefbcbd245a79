"""Relational operators of a versioned catalogue: dedup, upsert, browse, filters, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvine.functions.text import clean


def first_wins(df: DataFrame, key: str, order: str, payload: list[str]) -> DataFrame:
    """The first row of each key with the number of rows, the last order number and whether any payload differs from the first.

    The order numbers of all rows of a key are not gathered (see ``duplicate_rows``). Rows without a key are left out. The fields of later rows only count for ``payload_differs``.
    """
    rows = df.withColumn("__payload", F.to_json(F.struct(*payload), {"ignoreNullFields": "false"})).where(F.col(key).isNotNull())
    grouped = rows.groupBy(key).agg(
        F.min_by(F.struct(*payload), F.col(order)).alias("__first"),
        F.count("*").alias("n_rows"),
        F.max(order).alias("last_row"),
        (F.count_distinct("__payload") > 1).alias("payload_differs"),
    )
    return grouped.select(key, *(F.col(f"__first.{c}").alias(c) for c in payload), "n_rows", "last_row", "payload_differs")


def duplicate_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """Every row of a key with more than one, in long form: key, order, the first order of its key and the number of rows."""
    groups = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("first_row"), F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)
    return df.select(key, order).join(groups, key)


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str], run: int) -> DataFrame:
    """The state after run ``run``: new values win, rows that vanished stay but are inactive, ``first_seen`` is kept.

    ``old``: key, columns, first_seen, updated, is_active; ``new``: key, columns. Both with unique keys.
    """
    o, n = old.alias("o"), new.alias("n")
    there = F.col(f"n.{key}").isNotNull()
    pick = [F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(
        F.coalesce(f"n.{key}", f"o.{key}").alias(key),
        *pick,
        F.coalesce("o.first_seen", F.lit(run)).alias("first_seen"),
        F.when(there, F.lit(run)).otherwise(F.col("o.updated")).alias("updated"),
        there.alias("is_active"),
    )


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose keys it does not hold; the first of equal new rows."""
    fresh = new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def issues(df: DataFrame, kind: str, subject: Column, **detail: Column) -> DataFrame:
    """Rows of a data-quality log: kind, subject and a map of details."""
    pairs = [x for name, c in detail.items() for x in (F.lit(name), c.cast("string"))]
    return df.select(F.lit(kind).alias("kind"), subject.alias("subject"), F.create_map(*pairs).alias("detail"))


def contains_any_case(text: Column, needle: str | None) -> Column:
    """ILIKE '%needle%'; no needle keeps every row. ``%`` and ``_`` in the needle stay wildcards."""
    return F.lit(True) if not needle else F.coalesce(text.ilike(f"%{needle}%"), F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Rows of page ``number`` (from 1) with the total before paging; the total is a one-row aggregate, not a window over one partition."""
    total = df.agg(F.count("*").alias("total"))
    picked = df.orderBy(*order).offset((number - 1) * size).limit(size)
    # one row on the right
    return picked.join(F.broadcast(total), F.lit(True))


def latest(df: DataFrame, value: str, order: str, by: list[str]) -> DataFrame:
    """``value`` of the row with the greatest ``order`` of each group."""
    return df.groupBy(*by).agg(F.max(order).alias(order), F.max_by(value, order).alias(value))


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def first_attempt(attempts: list[DataFrame]) -> DataFrame:
    """The rows of the first attempt that found any, tagged with its number (from 1)."""
    tagged = reduce(DataFrame.unionByName, [a.withColumn("attempt", F.lit(i + 1)) for i, a in enumerate(attempts)])
    best = tagged.agg(F.min("attempt").alias("attempt"))
    return tagged.join(F.broadcast(best), "attempt")


def shared(df: DataFrame, key: str, owner: str) -> DataFrame:
    """Keys with more than one owner, one row an owner, with the number of owners."""
    owners = df.where(F.col(key).isNotNull()).select(key, owner).distinct()
    many = owners.groupBy(key).agg(F.count("*").alias("n_owners")).where(F.col("n_owners") > 1)
    return owners.join(many, key)


def sample_by_hash(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """A repeatable random sample of ``n`` rows: smallest keyed arithmetic hash first."""
    return df.withColumn("__h", F.pmod(F.col(key) * F.lit(1103515245) + F.lit(12345 + seed), F.lit(2147483648))).orderBy("__h", key).limit(n).drop("__h")


def text_or(c: Column, fallback: str) -> Column:
    return F.coalesce(clean(c), F.lit(fallback))
