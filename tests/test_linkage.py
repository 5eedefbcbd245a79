from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest

from corvine.operators.linkage import displace, link, mark_suspicious
from corvine.operators.search import similar_words
from corvine.session import ship_package

ITEMS = "item string, name_key string, item_key string, text string"
MEDIA = "path string, filename string, image string, key string, width int, height int, size long"


@pytest.fixture(scope="module", autouse=True)
def _shipped(spark):
    ship_package(spark)


def _ratio(a, b):
    if a == b:
        return 1.0
    return SequenceMatcher(None, a, b).ratio() if min(len(a), len(b)) >= 5 else 0.0


def test_similar_words_against_all_pairs(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdeo") for _ in range(rng.randint(4, 16))) for _ in range(25)]
    near = []
    for w in base:
        letters = list(w)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(letters))
            letters[at : at + rng.randint(0, 2)] = rng.choice(["x", "", "ab", letters[at]])
        near.append("".join(letters) or "a")
    frame = lambda ws: spark.createDataFrame([(w,) for w in sorted(set(ws))], "token string")
    found = {(r.token, r.query) for r in similar_words(frame(base), frame(near), 0.82, 5).collect()}
    assert found == {(a, b) for a in base for b in near if a != b and len(a) >= 5 and len(b) >= 5 and _ratio(b, a) >= 0.82} and len(found) > 5


def _by_hand(items, media):
    """The three tiers in a loop; candidates are files with the same words, by score, then words."""
    out, used = {}, set()
    best = lambda files: max(files, key=lambda m: (m[5] > m[4], m[6], m[0]))
    still = []
    for item, name_key, item_key, text in sorted(items):
        by_name, by_key = ([m for m in media if m[3] and m[3] == k] for k in (name_key, item_key))
        if by_name or by_key:
            m = best(by_name or by_key)
            used.add(m[2])
            out[item] = (m[2], m[0], "image_filename" if by_name else "slug", 1.0)
        else:
            still.append((item, text))
    words = lambda t: {w for w in t.split() if len(w) >= 3 and not w.isdigit()}
    free: dict = {}
    for m in sorted(media):
        if m[2] not in used and m[2] not in {x[2] for xs in free.values() for x in xs}:
            free.setdefault(" ".join(sorted(words(m[1].rsplit(".", 1)[0]))), []).append(m)
    for item, text in still:
        own, options = words(text), []
        for key, files in free.items():
            theirs = set(key.split())
            if not files or not theirs & own:
                continue
            total = sum(s for q in theirs if (s := max(_ratio(q, t) for t in own)) >= 0.82)
            score = round(0.8 * total / len(theirs) + 0.2 * total / len(own), 6)
            if score >= 0.72:
                options.append((-score, key))
        if options:
            score, key = min(options)
            m = free[key].pop(0)
            out[item] = (m[2], m[0], "fuzzy_filename", -score)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_three_tiers_against_a_loop(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["gravel", "gravell", "orchard", "orchrad", "tower", "towers", "meadow", "medow", "quarry", "harbour", "harbor", "old", "new", "dsc"]
    text = lambda n: " ".join(rng.sample(vocabulary, n))
    media = [(f"p{i:03d}", f"{text(rng.randint(1, 3))}.jpg", f"img{rng.randrange(40)}", rng.choice([None, f"k{rng.randrange(12)}"]), rng.choice([1, 2]), 1 + i % 2, rng.randrange(5)) for i in range(50)]
    items = [(f"w{i:03d}", rng.choice([None, f"k{rng.randrange(30)}"]), rng.choice([None, f"k{rng.randrange(30)}"]), text(rng.randint(1, 4))) for i in range(45)]
    found = {r.item: (r.image, r.path, r.mapping_kind, r.mapping_score) for r in link(spark.createDataFrame(items, ITEMS), spark.createDataFrame(media, MEDIA)).collect()}
    expected = _by_hand(items, media)
    assert found == expected and sum(v[2] == "fuzzy_filename" for v in found.values()) > 3


def test_marks_and_empty(spark):
    rows = [("a", "x", "slug", 1.0), ("b", "x", "slug", 1.0), ("c", "y", "fuzzy_filename", 0.8), ("d", "z", "fuzzy_filename", 0.9), ("e", "q", "slug", 1.0)]
    df = spark.createDataFrame(rows, "item string, image string, mapping_kind string, mapping_score double")
    assert {r.item for r in mark_suspicious(df).where("review_status = 'suspicious'").collect()} == {"a", "b", "c"}
    assert link(spark.createDataFrame([], ITEMS), spark.createDataFrame([], MEDIA)).collect() == []


def test_displacement(spark):
    held = spark.createDataFrame([("a", "x", "p1", "slug", 1.0, "auto"), ("b", "y", "p2", "slug", 1.0, "auto"), ("c", "z", "p3", "slug", 1.0, "auto"), ("d", "q", "p4", "slug", 1.0, "suspicious")], "item string, image string, path string, mapping_kind string, mapping_score double, review_status string")
    lines = [(2, "b", "set", "one.jpg"), (3, "e", "set", "one.jpg"), (4, "c", "reject", None), (5, "d", "confirm", None), (6, "f", "confirm", None), (7, "g", "set", "two.jpg"), (8, "h", "set", "none.jpg"), (9, "c", "confirm", None)]
    media = spark.createDataFrame([("one.jpg", "p1", "x"), ("two.jpg", "p5", "u"), ("two.jpg", "p6", "v")], "filename string, path string, image string")
    left, issues = displace(held, spark.createDataFrame(lines, "line_no long, item string, action string, filename string"), media)
    assert {(r.item, r.image, r.review_status) for r in left.collect()} == {("e", "x", "confirmed"), ("d", "q", "confirmed")}
    assert {tuple(r) for r in issues.collect()} == {("displaced", "a", 3), ("displaced", "b", 3), ("ambiguous_file", "g", 7), ("unknown_file", "h", 8), ("nothing_to_confirm", "f", 6)}
