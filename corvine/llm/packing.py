"""Containers of fixed capacity filled with items that are not split."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvine.llm.tokens import TOKENIZER_DIR, count_tokens
from corvine.session import cut, ship_package

#: Items that one task packs. The room left at the end of a task's packing is a few containers, whatever their number.
SHARD = 50_000


def sum_of_squares(sizes: list[int], capacity: int) -> list[int]:
    """The container (numbered from 0) of each item; sizes lie between 0 and the capacity.

    Each item goes where the sum over all gaps of (open containers with this gap) squared becomes
    smallest; opening a container is one of the choices, a full container counts no more. Of
    equal choices the smallest gap is taken, a new container last. Items come largest first, so
    that small ones close the gaps. Items of size 0 go to container 0.
    """
    open_by_gap: dict[int, list[int]] = {}
    n = np.zeros(capacity + 1, dtype=np.int64)
    place, used = [0] * len(sizes), 0
    far = np.int64(1) << 60
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[item]
        if size == 0:
            continue
        here = n[size:]
        change = np.where(here > 0, 2 * (n[: capacity + 1 - size] - here) + 2, far)
        if here[0] > 0:
            change[0] = 1 - 2 * here[0]
        k = int(change.argmin())
        fresh = 2 * n[capacity - size] + 1 if size < capacity else 0
        if change[k] <= fresh:
            gap = size + k
            n[gap] -= 1
            bin_ = open_by_gap[gap].pop()
            gap -= size
        else:
            bin_, used, gap = used, used + 1, capacity - size
        place[item] = bin_
        if gap:
            n[gap] += 1
            open_by_gap.setdefault(gap, []).append(bin_)
    return place


_PLACED = T.StructType(
    [T.StructField(n, t) for n, t in (("container_id", T.LongType()), ("doc_id", T.LongType()), ("part", T.IntegerType()), ("start", T.LongType()), ("n_tokens", T.LongType()))]
)


def pack(sizes: DataFrame, capacity: int, shard: int = SHARD) -> DataFrame:
    """``sizes``: doc_id, n_tokens. One row per piece: container_id, doc_id, part, start, n_tokens.

    An item longer than the capacity is cut into pieces of the capacity, each with a container of
    its own, and a rest that is packed like any item; no other item is cut. Items are dealt by
    hash into shards of bounded size that are packed on their own. Items of size 0 (null and
    empty texts) lie in the first container of their shard. A null doc_id is an item as well;
    repeated items are packed as often as they come. An empty table gives no row. ``sizes`` is
    read twice, so it should be a written table (see ``pack_specs``).
    """
    ship_package(sizes.sparkSession)
    sizes = sizes.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"))
    shards = max(1, -(-sizes.count() // shard))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        base = int(key[0]) << 32
        docs, totals = rows["doc_id"].tolist(), rows["n_tokens"].tolist()
        place = sum_of_squares([t if t <= capacity else t % capacity for t in totals], capacity)
        used = max(place, default=-1) + 1
        out = []
        for doc, total, bin_ in zip(docs, totals, place):
            whole = total // capacity if total > capacity else 0
            for part in range(whole):
                out.append((base + used, doc, part, part * capacity, capacity))
                used += 1
            if total > whole * capacity or total == 0:
                out.append((base + bin_, doc, whole, whole * capacity, total - whole * capacity))
        return pd.DataFrame(out, columns=_PLACED.names).astype({"container_id": "int64", "doc_id": "Int64", "part": "int32", "start": "int64", "n_tokens": "int64"})

    keyed = sizes.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(shards)))
    return keyed.groupBy("shard").applyInPandas(run, _PLACED)


def pack_specs(documents: DataFrame, specs: list[tuple[int, str, int]], folder: str = TOKENIZER_DIR) -> Iterator[tuple[int, int, DataFrame]]:
    """(spec_id, capacity, packing) of each specification (spec_id, tokenizer, capacity); each tokenizer measures the corpus once."""
    measured: dict[str, DataFrame] = {}
    for spec_id, tokenizer, capacity in specs:
        if tokenizer not in measured:
            measured[tokenizer] = cut(count_tokens(documents, "doc_id", "text", tokenizer, folder))
        yield spec_id, capacity, pack(measured[tokenizer], capacity)
