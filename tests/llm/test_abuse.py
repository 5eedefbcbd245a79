from __future__ import annotations

import random

import pytest

from corvine.llm.abuse import THRESHOLD, plain, train, windows, word_form
from corvine.llm.abuse_corpus import fit, rates, score_documents

# Invented words only: what counts as offensive is learnt from the labels.
_SYLLABLES = ("трыг", "кум", "вош", "щев", "лан", "бес", "зур", "мик", "дол", "рен", "фас", "хиг")
INSULTS = [a + b + "ак" for a in _SYLLABLES[:6] for b in _SYLLABLES[6:]]
OTHERS = [a + b + "ень" for a in _SYLLABLES[6:] for b in _SYLLABLES]
BAD = ["Этот сосед {} и больше никто.", "Слушай, {}, уйди отсюда.", "Брат твой {} полный.", "Ну и {} пришёл.", "Опять {} кричит, гнать его.", "Кто ты, {}?"]
CLEAN = ["Борка лемит {} много раз.", "Тувы сулят {}, а нерпа лежит.", "Шолка даёт {} и лист.", "Ступа шла через {}.", "Над рекой стоит {}.", "Утром сушили {} на доске.", "Кто купил {}?", "Сосед принёс {} и мёд."]


def _texts(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        toxic = i % 4 == 0
        lines = [rng.choice(CLEAN).format(rng.choice(OTHERS)) for _ in range(rng.randint(2, 6))]
        if toxic:
            lines.insert(rng.randrange(len(lines)), rng.choice(BAD).format(rng.choice(INSULTS)))
        out.append((i, " ".join(lines), toxic))
    return out


@pytest.fixture(scope="module")
def model():
    rng = random.Random(8)
    # one label in twelve is wrong
    return train([(text, float(toxic != (rng.random() < 0.08)), 2) for _, text, toxic in _texts(1, 2000)], rounds=2, epochs=6)


def test_held_out_accuracy(model):
    right = [(model.score(text) >= THRESHOLD) == toxic for _, text, toxic in _texts(2, 400)]
    assert sum(right) / len(right) >= 0.97


def test_disguises(model):
    for word in ("к.у.м.д.о.л.а.к", "кумд0лак", "кумдо\u200bлак", "КУМДОЛАККК", "к у м д о л а к", "кумдoлак", "ку\u0301мдолак"):
        assert model.score(f"Этот сосед {word} и больше никто.") >= THRESHOLD, word


def test_nothing_to_score(model):
    assert [model.score(x) for x in (None, "", " \n", "!!! 🥂")] == [0.0] * 4
    assert model.score("а " * 20_000) < THRESHOLD


def test_forms():
    assert word_form("2019") == "9" and word_form("сКОт".lower()) == "скот" and word_form("д3б1л") == "дебил"
    assert plain("Ќо­т") == "кот" and "идиот" in plain("ты и.д.и.о.т!")
    assert all(len(w) <= 24 for w in windows("слово " * 100)) and windows(None) == []


def test_corpus(spark):
    rows = [(i, t, "a" if i % 2 else None, 5) for i, t, _ in _texts(3, 120)] + [(1000, None, "a", 5), (1001, "", "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score int")
    votes = [(i, "x", int(t), None) for i, _, t in _texts(3, 120)]
    labels = spark.createDataFrame(votes + votes[:5] + [(5000, "x", 1, None), (1000, "x", 1, None), (1, "y", None, None)], "doc_id long, annotator string, toxic int, labelled_at timestamp")
    model = fit(docs, labels)
    scores = score_documents(docs, model)
    assert scores.count() == 122 and scores.where("doc_id >= 1000 and score <> 0").count() == 0
    assert {r.source: r.n_docs for r in rates(docs.union(docs.limit(0)), model).collect()} == {None: 60, "a": 62}
    assert fit(docs, labels.limit(0)).score("Этот сосед кумдолак и больше никто.") < THRESHOLD
    assert score_documents(docs.limit(0), fit(docs.limit(0), labels.limit(0))).collect() == []
