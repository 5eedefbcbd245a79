"""Spelling-proof forms of short names.

A name is written in another case, alphabet, keyboard layout or word order, with look-alike
letters, abbreviations and trade decoration around it. ``readings`` turns one string into the
few Latin skeletons it may stand for; names that mean the same then differ in a few letters only.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

_LAYOUT = str.maketrans(
    "qwertyuiop[]asdfghjkl;'zxcvbnm,.`",
    "йцукенгшщзхъфывапролджэячсмитьбюё",
)
#: Latin letters and digits that look like Cyrillic ones; upper case first, as B looks like В but b like ь.
_LOOKS_UPPER = str.maketrans("ABCEHKMOPTXYU", "АВСЕНКМОРТХУИ")
_LOOKS_LOWER = str.maketrans("abcehkmoprtuxyn03684", "авсенкморгтихупозбвч")
_LATIN_DIGITS = str.maketrans("01385", "olebs")
_CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "j", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m",
    "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "c", "ч": "q", "ш": "x", "щ": "x", "ъ": "",
    "ы": "i", "ь": "", "э": "e", "ю": "w", "я": "y",
}
#: Latin spellings of single sounds, applied in this order; capitals stand for finished signs.
_LATIN = (
    ("shch", "X"), ("sch", "X"), ("sh", "X"), ("ch", "Q"), ("zh", "J"), ("kh", "h"), ("ts", "C"), ("tc", "C"), ("ck", "k"), ("ph", "f"),
    ("ya", "Y"), ("ia", "Y"), ("ja", "Y"), ("yu", "W"), ("iu", "W"), ("ju", "W"), ("yo", "e"), ("jo", "e"), ("x", "ks"), ("w", "v"), ("q", "k"), ("c", "k"), ("y", "i"), ("j", "i"),
)
_RUN = re.compile(r"[^\W_]+")
_SHORT = re.compile(r"^\w{1,2}-\w{1,3}$")


def _plain(text: str) -> str:
    text = unicodedata.normalize("NFKC", text)
    return "".join(ch for ch in text if unicodedata.category(ch) != "Cf")


@lru_cache(maxsize=200_000)
def skeleton(word: str) -> str:
    """Latin skeleton of one word in [a-z0-9]."""
    if re.search("[а-яё]", word):
        out = "".join(_CYRILLIC.get(ch, ch) for ch in word)
        out = out.replace("ia", "y").replace("iu", "w").translate(_LATIN_DIGITS)
    else:
        out = word.translate(_LATIN_DIGITS) if re.search("[a-z]", word) else word
        out = "".join(ch for ch in unicodedata.normalize("NFD", out) if not unicodedata.combining(ch))
        for old, new in _LATIN:
            out = out.replace(old, new)
        out = out.lower()
    return re.sub("[^a-z0-9]", "", re.sub("i{2,}", "i", out))


def _words(text: str) -> list[str]:
    """Words of a text; a word with a dot or ``x-yy`` behind it is an abbreviation and keeps its mark."""
    found = []
    for raw in re.findall(r"[\w'’-]+\.?", text):
        raw = raw.strip("'’-_")
        if _SHORT.match(raw):
            found.append(raw)
        else:
            found += [p for p in re.split(r"[-_]", raw.replace("'", "").replace("’", "")) if p.strip(".")]
    return found


def _variants(plain: str, extra: frozenset, own: frozenset) -> list[str]:
    """The text without the decoration that no listed name uses, and without the first of each that one does as well; as it is where an abbreviation may have gone or nothing would be left."""
    if not extra:
        return [plain]
    found, once = [], set()

    def bare(m: re.Match) -> str:
        word = m.group().lower()
        gone = word in extra and (word not in own or word not in once)
        once.add(word)
        return "" if gone else m.group()

    for left in (_RUN.sub(lambda m: "" if m.group().lower() in extra - own else m.group(), plain), _RUN.sub(bare, plain)):
        if left not in found and _RUN.search(left):
            found.append(left)
    if not found or any(m.group(1).lower() in extra for m in re.finditer(r"([^\W_]{1,2})[.-]", plain)):
        found.append(plain)
    return found


def _marked(word: str) -> str:
    if _SHORT.match(word):
        return "-".join(map(skeleton, word.split("-")))
    return skeleton(word.rstrip(".")) + "." * word.endswith(".")


def readings(text: str | None, extra: frozenset = frozenset(), own: frozenset = frozenset()) -> list[str]:
    """The skeletons ``text`` may stand for, each as words joined by blanks. ``extra``: words around names; ``own``: those of them that are part of some listed name."""
    if not text or not text.strip():
        return []
    out = []
    for plain in _variants(_plain(text), extra, own):
        for form in _alphabets(plain):
            words = [m for m in map(_marked, _words(form.replace("ё", "е"))) if m.strip(".-")]
            if words and (joined := " ".join(words)) not in out:
                out.append(joined)
    return out


def _alphabets(plain: str) -> list[str]:
    """Lower-case forms of a text in the alphabets and keyboard layouts it may have been typed in."""
    low = plain.lower()
    if re.search("[а-я]", low) or ("ё" in low and not re.search("[a-z]", low)):
        looks = plain.translate(_LOOKS_UPPER).lower()
        if not (re.search("[a-z]", looks) and re.search("[а-яё]", re.sub(r"[a-z]{3,}", "", looks))):
            return [re.sub(r"(?<=[а-яё])[03684]|[03684](?=[а-яё])", lambda m: m.group().translate(_LOOKS_LOWER), looks)]
        pieces = re.split(r"(\b[a-z]+\b)", looks)
        mixed = "".join(p if i % 2 and len(p) > 2 and not _all_alike(p) else p.translate(_LOOKS_LOWER) for i, p in enumerate(pieces))
        return [mixed, looks.translate(_LOOKS_LOWER)] + [low] * bool(re.search("[a-z]{3,}", low))
    forms = [low, low.translate(_LAYOUT)]
    if re.search(r"\d", low) and re.search("[a-z]", low):
        forms.append(low.replace("ё", "`").translate(_LOOKS_LOWER))
    return forms


def _all_alike(word: str) -> bool:
    return all(ch in "acekmoptxyhbun" for ch in word)


_SOUNDS = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i y k l m n o p r s t u f h ts ch sh shch  y  e yu ya".split(" ")))


def letters(text: str | None, extra: frozenset = frozenset(), own: frozenset = frozenset()) -> str:
    """The words of ``text`` in lower case without the decoration that no listed name uses, run together, in Latin letters: for names spelt in Latin a closer form than the skeleton."""
    if not text:
        return ""
    word = "".join(w.rstrip(".") for w in _words(_variants(_plain(text), extra - own, frozenset())[0].lower()))
    return "".join(_SOUNDS.get(ch, ch) for ch in word)


def osa(a: str, b: str, limit: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) from a to b, or limit + 1 if more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    # only cells within ``limit`` of the diagonal can belong to a way that is short enough
    far, width = limit + 1, len(b)
    before, last = [], [min(j, far) for j in range(width + 1)]
    for i, x in enumerate(a, 1):
        low, high = max(1, i - limit), min(width, i + limit)
        row = [far] * (width + 1)
        if i <= limit:
            row[0] = i
        best = row[low - 1]
        for j in range(low, high + 1):
            y = b[j - 1]
            edits = last[j - 1] + (x != y)
            if last[j] < edits:
                edits = last[j] + 1
            if row[j - 1] < edits:
                edits = row[j - 1] + 1
            if i > 1 and j > 1 and before[j - 2] < edits and x == b[j - 2] and a[i - 2] == y:
                edits = min(edits, before[j - 2] + 1)
            row[j] = edits
            if edits < best:
                best = edits
        if best > limit:
            return far
        before, last = last, row
    return min(last[-1], far)


def allowed(length: int) -> int:
    """Edits that a name of so many letters may carry."""
    return 0 if length < 4 else 1 if length < 6 else 2


def _word_cost(word: str, target: str, limit: int) -> float:
    if word.endswith(".") and len(word) <= len(target) and target.startswith(word[:-1]):
        return 0.25
    if "-" in word:
        head, _, tail = word.partition("-")
        return 0.25 if target.startswith(head) and target.endswith(tail) else limit + 1
    return osa(word.rstrip("."), target, limit)


def least_matching(costs: list[list[float]]) -> tuple[float, bool]:
    """Least total of a square table with one entry of each row and column, and whether the diagonal has it. Shortest augmenting paths: cubic time."""
    n = len(costs)
    diagonal = sum(costs[i][i] for i in range(n))
    up, down, owner = [0.0] * (n + 1), [0.0] * (n + 1), [n] * (n + 1)
    for i in range(n):
        owner[n], at = i, n
        slack, back, done = [float("inf")] * n, [n] * n, [False] * (n + 1)
        while owner[at] != n:
            done[at] = True
            row, step, nearest = owner[at], float("inf"), n
            for j in range(n):
                if not done[j]:
                    left = costs[row][j] - up[row] - down[j]
                    if left < slack[j]:
                        slack[j], back[j] = left, at
                    if slack[j] < step:
                        step, nearest = slack[j], j
            for j in range(n + 1):
                if done[j]:
                    up[owner[j]] += step
                    down[j] -= step
                elif j < n:
                    slack[j] -= step
            at = nearest
        while at != n:
            owner[at] = owner[back[at]]
            at = back[at]
    total = sum(costs[owner[j]][j] for j in range(n))
    return total, diagonal <= total + 1e-9


def cost(reading: str, name: str, gone: frozenset = frozenset()) -> float | None:
    """How far ``reading`` is from the listed ``name`` (both skeletons), or None if it cannot mean it.

    Words may stand in any order (the cheapest matching of words counts); one word of the name that is in ``gone`` (skeletons) may be missing; blanks may be missing or too many.
    """
    words, target = reading.split(" "), name.split(" ")
    limit = allowed(sum(map(len, target)))
    best = float(osa("".join(words).replace(".", "").replace("-", ""), "".join(target), limit))
    options = []
    if best > 0 and len(words) == len(target):
        options = [target]
    elif best > 0 and len(words) + 1 == len(target):
        options = [target[:i] + target[i + 1 :] for i, w in enumerate(target) if w in gone]
    for option in options:
        room = allowed(sum(map(len, option)))
        total, in_order = least_matching([[_word_cost(word, aim, room) for aim in option] for word in words])
        total += 0.5 * (len(option) < len(target)) + 0.01 * (not in_order)
        if total <= room + 0.99:
            best = min(best, total)
    return best if best < limit + 1 else None
