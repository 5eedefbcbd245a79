"""Russian stems by the published Snowball steps."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOWEL = "аеиоуыэюя"
_GERUND_A = re.compile("(?<=[ая])(вшись|вши|в)$")
_GERUND_B = re.compile("(ившись|ывшись|ивши|ывши|ив|ыв)$")
_REFLEXIVE = re.compile("(ся|сь)$")
_ADJECTIVE = re.compile("(ими|ыми|его|ого|ему|ому|ее|ие|ые|ое|ей|ий|ый|ой|ем|им|ым|ом|их|ых|ую|юю|ая|яя|ою|ею)$")
_PARTICIPLE_A = re.compile("(?<=[ая])(ем|нн|вш|ющ|щ)$")
_PARTICIPLE_B = re.compile("(ивш|ывш|ующ)$")
_VERB_A = re.compile("(?<=[ая])(ешь|нно|ете|йте|ла|на|ли|ем|ло|но|ет|ют|ны|ть|й|л|н)$")
_VERB_B = re.compile("(ейте|уйте|ила|ыла|ена|ите|или|ыли|ило|ыло|ено|ует|уют|ены|ить|ыть|ишь|ей|уй|ил|ыл|им|ым|ен|ят|ит|ыт|ую|ю)$")
_NOUN = re.compile("(иями|ями|ами|ией|иям|ием|иях|ев|ов|ие|ье|еи|ии|ей|ой|ий|ям|ем|ам|ом|ах|ях|ию|ью|ия|ья|а|е|и|й|о|у|ы|ь|ю|я)$")
_SUPERLATIVE = re.compile("(ейше|ейш)$")
_DERIVATION = re.compile("(ость|ост)$")


def _without(region: str, *patterns: re.Pattern) -> str | None:
    for pattern in patterns:
        if found := pattern.search(region):
            return region[: found.start()]
    return None


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    word = word.lower().replace("ё", "е")
    first = re.search(f"[{_VOWEL}]", word)
    if not first:
        return word
    head, rv = word[: first.end()], word[first.end() :]
    r1 = re.search(f"[{_VOWEL}][^{_VOWEL}]", word)
    r2 = re.search(f"[{_VOWEL}][^{_VOWEL}]", word[r1.end() :]) if r1 else None
    r2_start = r1.end() + r2.end() if r1 and r2 else len(word)
    cut = _without(rv, _GERUND_B, _GERUND_A)
    if cut is None:
        rv = _REFLEXIVE.sub("", rv)
        cut = _without(rv, _ADJECTIVE)
        if cut is not None:
            inner = _without(cut, _PARTICIPLE_B, _PARTICIPLE_A)
            cut = cut if inner is None else inner
        else:
            cut = _without(rv, _VERB_B, _VERB_A)
            if cut is None:
                cut = _without(rv, _NOUN)
    rv = rv if cut is None else cut
    rv = rv.removesuffix("и")
    derived = _DERIVATION.search(rv)
    if derived and len(head) + derived.start() >= r2_start:
        rv = rv[: derived.start()]
    if rv.endswith("нн"):
        rv = rv[:-1]
    else:
        shorter = _SUPERLATIVE.sub("", rv)
        if shorter != rv:
            rv = shorter[:-1] if shorter.endswith("нн") else shorter
        else:
            rv = rv.removesuffix("ь")
    return head + rv


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stems of the Cyrillic words of a text; other words as they are, in lower case."""
    for texts in batches:
        yield pd.Series([[] if t is None else sorted({stem(w) for w in re.findall(r"\w+", t.lower())}) for t in texts], dtype=object)
