from __future__ import annotations

import os
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corvine.llm.packing import pack, sum_of_squares
from corvine.llm.tokens import PATTERN, TOKENIZER_DIR, Encoding, PrefixEncoder, count_tokens, encode_texts

pytestmark = pytest.mark.skipif(not os.path.isdir(TOKENIZER_DIR), reason="no vocabularies")


@pytest.fixture(scope="module", params=["byte_bpe_50k", "byte_bpe_multi_50k"])
def pair(request):
    with open(os.path.join(TOKENIZER_DIR, f"{request.param}.tiktoken"), "rb") as f:
        encoder = PrefixEncoder.from_file(f.read())
    return encoder, tiktoken.Encoding("reference", pat_str=PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=60), st.text("ab '\n", max_size=40), st.text("ыжё aA1!", max_size=40)))
def test_ids(pair, text):
    encoder, reference = pair
    ids = encoder.encode(text)
    assert ids == reference.encode_ordinary(text) and encoder.decode(ids) == text


def test_long_pieces(pair):
    encoder, reference = pair
    for text in ("a" * 3000, "ab" * 1000, "ж" * 800, " " * 500 + "x", "!?" * 400):
        assert encoder.encode(text) == reference.encode_ordinary(text)


def test_appends_and_edits(pair):
    encoder, reference = pair
    rng = random.Random(1)
    parts = ["a", "aa", "b", " ", "  ", "'", "s", "ll", "re", "\n", "ё", "жж", "1", "!!", "​", "🥂"]
    some = lambda n: "".join(rng.choice(parts) for _ in range(rng.randint(0, n)))
    for _ in range(400):
        text = some(25)
        state = Encoding(encoder, text)
        for _ in range(3):
            if rng.random() < 0.5:
                more = some(5)
                state.append(more)
                text += more
            else:
                i = rng.randint(0, len(text))
                j, new = rng.randint(i, len(text)), some(4)
                state.replace(i, j, new)
                text = text[:i] + new + text[j:]
            assert state.text == text and state.ids == reference.encode_ordinary(text), text


def test_corpus(spark):
    texts = ["Каберне Совиньон, 2019", "", None, "  ", "<|endoftext|> it's", "x" * 20_000, "Каберне Совиньон, 2019"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    other = Tokenizer.from_file(os.path.join(TOKENIZER_DIR, "byte_bpe_50k.json"))
    other.encode_special_tokens = True
    expected = {i: other.encode(t, add_special_tokens=False).ids if t else [] for i, t in enumerate(texts)}
    assert {r.doc_id: list(r.ids) for r in encode_texts(df, "doc_id", "text").collect()} == expected
    assert {r.doc_id: r.n_tokens for r in count_tokens(df, "doc_id", "text").collect()} == {i: len(v) for i, v in expected.items()}
    assert encode_texts(df.limit(0), "doc_id", "text").collect() == []


def test_sum_of_squares_fills():
    rng = random.Random(4)
    for capacity in (10, 64, 512):
        sizes = [rng.randint(0, capacity) for _ in range(2000)]
        load: dict = {}
        for bin_, size in zip(sum_of_squares(sizes, capacity), sizes):
            load[bin_] = load.get(bin_, 0) + size
        assert max(load.values()) <= capacity
        assert len(load) <= 1.08 * -(-sum(sizes) // capacity) + 2
    assert sum_of_squares([], 5) == [] and sum_of_squares([0, 0], 5) == [0, 0] and sum_of_squares([5, 5], 5) == [0, 1]


def test_pack(spark):
    sizes = [(1, 7), (2, 0), (3, 25), (4, 10), (5, 3), (None, 3), (6, 30), (7, 3), (7, 3)]
    for shard in (50_000, 3):
        rows = pack(spark.createDataFrame(sizes, "doc_id long, n_tokens long"), 10, shard).collect()
        load: dict = {}
        for r in rows:
            load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
        assert max(load.values()) <= 10
        pieces: dict = {}
        for r in rows:
            pieces.setdefault(r.doc_id, []).append((r.part, r.start, r.n_tokens))
        assert sorted(pieces[3]) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)] and sorted(pieces[6]) == [(0, 0, 10), (1, 10, 10), (2, 20, 10)]
        assert pieces[2] == [(0, 0, 0)] and pieces[4] == [(0, 0, 10)] and len(pieces[7]) == 2 and pieces[None] == [(0, 0, 3)]
    assert pack(spark.createDataFrame([], "doc_id long, n_tokens long"), 10).collect() == []
