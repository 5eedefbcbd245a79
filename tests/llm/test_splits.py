from __future__ import annotations

import itertools
import random
import tracemalloc

import pytest

from corvine.llm.splits import assign, choose, components, leaks, related

SCHEMA = "entry_id long, g string, h string, split string, component string"


def _brute(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, g, h, _ in rows:
        find(("e", i))
        for kind, key in (("g", g), ("h", h)):
            if key and key.strip():
                parent[find(("e", i))] = find((kind, key.strip().lower()))
    return {i: find(("e", i)) for i, *_ in rows}


def _frame(spark, rows):
    return spark.createDataFrame(rows, "entry_id long, g string, h string, split string, node string, rank string")


def _rows(seed, n=300):
    rng = random.Random(seed)
    pick = lambda p, m: rng.choice([None, "", " "]) if rng.random() < 0.2 else rng.choice(["", " "]) + rng.choice([str.upper, str.lower])(f"{p}{rng.randrange(m)}")
    return [(i, "hot" if rng.random() < 0.3 else pick("g", 80), pick("h", 160), rng.choice(["tuning", "Tuning ", "holdout", "pilot", None, " "])) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_leaks_against_union_find(spark, seed):
    rows = _rows(seed)
    root = _brute(rows)
    splits: dict = {}
    for i, _, _, s in rows:
        if s and s.strip():
            splits.setdefault(root[i], set()).add(s.strip().lower())
    expected = sorted(i for i, *_ in rows if len(splits.get(root[i], ())) > 1)
    df = related(_frame(spark, [(*r, "x", "y") for r in rows]), "entry_id", ["g", "h"])
    assert sorted(r.entry_id for r in leaks(df, "split").collect()) == expected
    groups: dict = {}
    for r in df.collect():
        groups.setdefault(r.component, set()).add(r.entry_id)
    brute: dict = {}
    for i, r in root.items():
        brute.setdefault(r, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def test_long_chain(spark):
    """Hooking and shortcutting takes few rounds on a path."""
    order = list(range(60))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])), "u long, v long")
    assert {r.root for r in components(edges).collect()} == {0}


def test_empty_and_unkeyed(spark):
    assert leaks(related(_frame(spark, []), "entry_id", ["g", "h"]), "split").collect() == []
    rows = related(_frame(spark, [(1, None, " ", "pilot", "", ""), (2, None, None, "tuning", "", ""), (3, "a", None, None, "", "")]), "entry_id", ["g", "h"])
    assert rows.select("component").distinct().count() == 3 and leaks(rows, "split").collect() == []
    assert assign(rows.limit(0), [("a", 1.0)]).collect() == []


def test_assignment_keeps_components_and_shares(spark):
    rows = related(_frame(spark, [(*r, "x", "y") for r in _rows(4, 500)]), "entry_id", ["g", "h"])
    out = assign(rows, [("tuning", 0.6), ("holdout", 0.2), ("pilot", 0.2)]).collect()
    assert len(out) == 500
    of: dict = {}
    for r in out:
        of.setdefault(r.component, set()).add(r.new_split)
    assert all(len(s) == 1 for s in of.values())
    biggest = max(sum(1 for r in out if r.component == c) for c in of)
    if biggest <= 300:
        assert abs(sum(r.new_split == "tuning" for r in out) - 300) <= 1


def test_choose_stays_small():
    """Memory for many rows does not grow with their number where small components close every gap."""
    sizes = {s: 60_000_000 // (s * s) for s in range(1, 600)} | {5_000_000: 2, 300_000_000: 1}
    target = sum(s * m for s, m in sizes.items()) * 6 // 10
    tracemalloc.start()
    taken = choose(sizes, target)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(s * n for s, n in taken.items()) == target and peak < 2_000_000


@pytest.mark.parametrize("few", [0, 1 << 14])
def test_choose_against_all_subsets(few, monkeypatch):
    monkeypatch.setattr("corvine.llm.splits.FEW_SUMS", few)
    rng = random.Random(9)
    for k in range(120):
        sizes = [rng.choice([1, 1, 2, 3, 7, 19, 40, 41]) if k % 3 else rng.randint(1, 9) * (1 + k % 2) for _ in range(rng.randint(1, 9))]
        target = rng.randint(0, sum(sizes) + 3)
        table = {s: sizes.count(s) for s in sizes}
        taken = choose(table, target)
        assert all(0 <= n <= table[s] for s, n in taken.items())
        best = min(abs(sum(c) - target) for k in range(len(sizes) + 1) for c in itertools.combinations(sizes, k))
        assert abs(sum(s * n for s, n in taken.items()) - target) == best
