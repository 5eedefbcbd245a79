"""Abusive, hateful and sexual content."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np

BUCKETS = 1 << 18
DIM = 12
#: Words of a window; longer sentences are scored in windows that overlap by half.
WINDOW = 24

_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿︀-️]")
_MARKS = re.compile("[̀-̅̇̉-ͯ]")
_LETTER = r"(?:[^\W_]|[@$*])"
_SPELT = re.compile(rf"(?<![^\W_]){_LETTER}([.\-_ ·]){_LETTER}(?:\1{_LETTER})+(?![^\W_])")
_WORD = re.compile(r"[^\W_](?:[^\W_]|[@$*'](?=[^\W_@$*]|[@$*]))*[@$]?|[@$*]+[^\W_](?:[^\W_]|[@$*'](?=[^\W_]|[@$*]))*[@$]?")
_CYRILLIC = re.compile("[а-яё]")
_TO_CYRILLIC = str.maketrans("aceopxyktmhb0134568@$7u", "асеорхуктмнвоиечпбвастu")
_TO_LATIN = str.maketrans("013457@$8", "oieastasb")
_RUNS = re.compile(r"(.)\1+")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|[\U0001F300-\U0001FAFF\u2600-\u27BF]+|[\r\n  \x85\v\f]+")


def plain(text: str) -> str:
    """Lower case without invisible characters and accents, letters that were spelt apart joined."""
    text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    text = unicodedata.normalize("NFC", _MARKS.sub("", unicodedata.normalize("NFD", text))).lower()
    return _SPELT.sub(lambda m: m.group().replace(m.group(1), ""), text)


@lru_cache(maxsize=200_000)
def word_form(word: str) -> str:
    """One spelling of a word: look-alike letters and digits in the script of the word, masking signs dropped, repeated letters once; numbers become 9."""
    if word.isdigit():
        return "9"
    bare = word.replace("*", "").replace("'", "")
    bare = bare.translate(_TO_CYRILLIC) if _CYRILLIC.search(bare) else bare.translate(_TO_LATIN)
    return _RUNS.sub(r"\1", bare.replace("ё", "е"))


def _sentence(sentence: str) -> list[tuple[str, ...]]:
    words = tuple(f for f in map(word_form, _WORD.findall(sentence)) if f)
    if len(words) <= WINDOW:
        return [words] if words else []
    return [words[i : i + WINDOW] for i in range(0, len(words) - WINDOW // 2, WINDOW // 2)]


def windows(text: str | None) -> list[tuple[str, ...]]:
    """The word forms of each sentence of the text, long sentences in overlapping windows."""
    return [w for sentence in _SENTENCE.split(plain(text)) for w in _sentence(sentence)] if text else []


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8")) % BUCKETS


@lru_cache(maxsize=200_000)
def word_slots(word: str) -> tuple[int, ...]:
    """Buckets of a word and its character 3- to 5-grams."""
    edge = f"<{word}>"
    grams = {edge[i : i + n] for n in (3, 4, 5) for i in range(len(edge) - n + 1)}
    return tuple(sorted({_slot(g) for g in grams} | {_slot("w:" + word)}))


def pair_slot(a: str, b: str) -> int:
    return _slot(f"p:{a} {b}")


def bag(words: tuple[str, ...]) -> list[int]:
    slots = [s for w in words for s in word_slots(w)]
    return slots + [pair_slot(a, b) for a, b in zip(words, words[1:])]


class Classifier:
    """Averaged subword embeddings and a linear softmax over two classes. Only the product of both is needed to score."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self._words: dict[str, tuple[float, int]] = {}
        self._pairs: dict[tuple[str, str], float] = {}
        self._sentences: dict[str, float] = {}

    def window(self, words: tuple[str, ...]) -> float:
        total, n = 0.0, 0
        for w in words:
            known = self._words.get(w)
            if known is None:
                if len(self._words) > 1_000_000:
                    self._words.clear()
                slots = word_slots(w)
                known = self._words[w] = (float(self.weights[list(slots)].sum()), len(slots))
            total += known[0]
            n += known[1]
        for pair in zip(words, words[1:]):
            value = self._pairs.get(pair)
            if value is None:
                if len(self._pairs) > 1_000_000:
                    self._pairs.clear()
                value = self._pairs[pair] = float(self.weights[pair_slot(*pair)])
            total += value
        n += len(words) - 1
        return total / n + self.bias

    def _worst(self, sentence: str) -> float:
        """Highest logit of the windows of a sentence; standard phrases and copied texts repeat, so the last ones are kept."""
        known = self._sentences.get(sentence)
        if known is None:
            known = max(map(self.window, _sentence(sentence)), default=-np.inf)
            if len(sentence) <= 1_000:
                if len(self._sentences) > 50_000:
                    self._sentences.clear()
                self._sentences[sentence] = known
        return known

    def score(self, text: str | None) -> float:
        """Probability of the worst window; 0 for a text without words."""
        logit = max(map(self._worst, _SENTENCE.split(plain(text)))) if text else -np.inf
        return 0.0 if logit == -np.inf else float(1 / (1 + np.exp(-min(max(logit, -30.0), 30.0))))


def _epochs(bags: list[np.ndarray], target: np.ndarray, weight: np.ndarray, epochs: int, seed: int) -> Classifier:
    """Embeddings and softmax trained together by mini-batches with adaptive steps."""
    if not bags:
        return Classifier(np.zeros(BUCKETS), -1.0)
    rng = np.random.default_rng(seed)
    # only the buckets that occur are trained: numbered once, so that a batch works on small tables
    buckets, flat = np.unique(np.concatenate(bags), return_inverse=True)
    flat, ends = flat.astype(np.int32), np.cumsum([0, *map(len, bags)])
    table = rng.uniform(-1 / DIM, 1 / DIM, (len(buckets), DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    seen_t, seen_o, seen_b = np.full(len(buckets), 1e-8, np.float32), np.full((DIM, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    lengths = np.diff(ends)
    target, weight = target.astype(np.float32), weight.astype(np.float32)
    for epoch in range(epochs):
        step = 0.5 * (1 - epoch / epochs) + 0.02
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), 256):
            rows = order[lo : lo + 256]
            slots = np.concatenate([flat[ends[i] : ends[i + 1]] for i in rows])
            starts = np.concatenate([[0], np.cumsum(lengths[rows])[:-1]])
            mean = np.add.reduceat(table[slots], starts) / lengths[rows][:, None].astype(np.float32)
            logits = mean @ out + bias
            logits -= logits.max(1, keepdims=True)
            gradient = np.exp(logits)
            gradient /= gradient.sum(1, keepdims=True)
            gradient[:, 1] -= target[rows]
            gradient[:, 0] -= 1 - target[rows]
            gradient *= weight[rows][:, None]
            g_out, g_bias = mean.T @ gradient, gradient.sum(0)
            g_mean = gradient @ out.T / lengths[rows][:, None].astype(np.float32)
            # gradients of one bucket next to each other, summed in runs
            by_slot = np.argsort(slots, kind="stable")
            ordered = slots[by_slot]
            runs = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            used = ordered[runs]
            g_table = np.add.reduceat(g_mean[np.repeat(np.arange(len(rows)), lengths[rows])[by_slot]], runs)
            seen_t[used] += (g_table**2).mean(1)
            table[used] -= step * g_table / np.sqrt(seen_t[used])[:, None]
            seen_o += g_out**2
            out -= step * g_out / np.sqrt(seen_o)
            seen_b += g_bias**2
            bias -= step * g_bias / np.sqrt(seen_b)
    weights = np.zeros(BUCKETS)
    weights[buckets] = table @ (out[:, 1] - out[:, 0])
    return Classifier(weights, float(bias[1] - bias[0]))


#: A text is called offensive from this probability of its worst window on.
THRESHOLD = 0.5
#: Share of clean texts whose worst window may look more offensive than one that is accepted, if one annotator called the text offensive, and if several did.
NULL_SHARE = (0.01, 0.05)


def _turn(texts: list, judge) -> tuple[list, np.ndarray, np.ndarray]:
    """Windows with the class and weight that ``judge`` (window, text number -> logit) gives them in the texts they stand in."""
    scored = [[judge(w, i) for w in own] for i, (own, _, _) in enumerate(texts)]
    worst = sorted(max(s) for (_, share, _), s in zip(texts, scored) if s and share < 0.5)
    bars = [worst[int(len(worst) * (1 - part))] if worst else 0.0 for part in NULL_SHARE]
    bad: Counter = Counter()
    clean: Counter = Counter()
    for (own, share, judges), logits in zip(texts, scored):
        if share == 0.5 or not logits:
            continue
        top, several = max(logits), judges > 1
        for w, logit in zip(own, logits):
            if share > 0.5:
                # An offensive text holds at least one offensive window. Where even the worst looks like those of clean texts
                # the label is most likely wrong, and where one explains the label a doubtful one beside it does not count.
                if logit > 0 and logit > top - 5:
                    bad[w] += 1
                elif logit == top and logit > bars[several]:
                    bad[w] += 1 if several else 0.4
                else:
                    clean[w] += 1 if logit < 0 else 0
            elif logit < 2:
                # what looks very offensive in a text called clean was most likely missed, and is left out
                clean[w] += 1
    rows = [w for w in dict.fromkeys([*bad, *clean]) if bad[w] + clean[w] > 0]
    n_bad, n_clean = np.array([bad[w] for w in rows], float), np.array([clean[w] for w in rows], float)
    if not n_bad.sum():
        return [], n_bad[:0], n_clean[:0]
    target = n_bad / (n_bad + n_clean)
    weight = np.sqrt(n_bad + n_clean)
    balance = (weight * (1 - target)).sum() / max((weight * target).sum(), 1e-9)
    weight = weight * (1 + target * (min(max(balance, 1.0), 4.0) - 1))
    return rows, target, weight / weight.mean()


def train(labelled: list[tuple[str, float, int]], rounds: int = 3, epochs: int = 8, seed: int = 7) -> Classifier:
    """From (text, share of its annotators who called it toxic, number of annotators).

    A label belongs to a whole text, the offence to one sentence of it, and annotators err. So a
    text is a set of windows, and the windows that are offensive are found in turns: at first
    those whose words are met far more often in offensive than in clean texts, then those that a
    model calls offensive which was trained on the other half of the texts, so that no wrong
    label can vouch for itself. Copies of one text fall into the same half. Without texts of
    both classes nothing is learnt and every text scores below the threshold.
    """
    texts = [(list(dict.fromkeys(windows(text))), share, judges) for text, share, judges in labelled]
    texts = [t for t in texts if t[0]]
    half = [zlib.crc32(" ".join(max(own, key=len)).encode("utf-8")) % 2 for own, _, _ in texts]
    words = [[Counter(), Counter()], [Counter(), Counter()]]
    sums = np.full((2, 2), 1.0)
    for (own, share, _), h in zip(texts, half):
        if share != 0.5:
            words[h][share > 0.5].update({w for window in own for w in window})
            sums[h, int(share > 0.5)] += 1

    def odds(word: str, h: int) -> float:
        return float(np.log((words[h][1][word] + 0.25) / (sums[h, 1] + 0.5)) - np.log((words[h][0][word] + 0.25) / (sums[h, 0] + 0.5)))

    def judge(window: tuple[str, ...], i: int) -> float:
        found = sorted((odds(w, 1 - half[i]) for w in window), reverse=True)[:4]
        return sum(found) / len(found) - 0.8

    for turn in range(rounds):
        models = []
        for h in (0, 1):
            rows, target, weight = _turn([t if half[i] == h else ([], 0.5, 0) for i, t in enumerate(texts)], judge)
            models.append(_epochs([np.array(bag(w)) for w in rows], target, weight, epochs, seed + turn))

        def judge(window: tuple[str, ...], i: int, models: list = models) -> float:
            return models[1 - half[i]].window(window)

    rows, target, weight = _turn(texts, judge)
    return _epochs([np.array(bag(w)) for w in rows], target, weight, 2 * epochs, seed)
