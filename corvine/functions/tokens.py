"""Words of labels and names as comparable tokens."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of several signs, silent endings and digraphs folded in this order, word lists and bounds.
MANY_SIGNS = {"ж": "zh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ю": "yu", "я": "ya"}
ONE_SIGN = ("абвгдеёзийклмнопрстуфхыэ", "abvgdeeziyklmnoprstufhye")
ACCENTS = ("àâäáéèêëíîïóôöúûüùçñ", "aaaaeeeeiiiooouuuucn")
PHONETIC = (
    (r"(?<=ri)s$", ""), (r"(?<=nc)s$", ""), (r"(?<=[aeiou])h$", ""), (r"gi(?=[aou])", "dzh"), (r"ge$", "zh"),
    (r"ier$", "e"), (r"eu", "e"), (r"(?<=[^aeiou])yu", "u"),
    (r"eau", "o"), (r"ch", "sh"), (r"oi", "ua"), (r"ou", "u"), (r"au", "o"), (r"ai", "e"), (r"gn", "n"),
    (r"ie", "i"), (r"ay$", "e"), (r"(?<=n)c$", ""), (r"(?<=[eo])[tdx]$", ""),
    (r"(?<=[aeiou])s(?=[aeiou])", "z"), (r"c(?=[eiy])", "s"), (r"c", "k"), (r"q", "k"), (r"w", "v"),
    (r"x", "ks"), (r"y", "i"), (r"(.)\1", "$1"), (r"(?<=[^aeiou])e$", ""),
)
STOP_WORDS = (
    "beloe", "butylka", "etiketka", "igristoe", "krasnoe", "rozovoe", "suhoe", "vino", "wine", "winery",
    "vinodelnya", "semeynaya", "territorii", "rossiyskoy", "federatsii",
)
MIN_TOKEN, FUZZY_MIN, FUZZY_GAP, PREFIX_MIN, PREFIX_SIMILARITY, TOKEN_MATCH = 3, 5, 2, 6, 0.9, 0.82
DRY, SEMI_DRY, SEMI_SWEET, SWEET = "сухое", "полусухое", "полусладкое", "сладкое"
BRUT, EXTRA_BRUT, BRUT_NATURE = "брют", "экстра брют", "брют натюр"
#: Sugar levels as whole words between single blanks, from the most to the least special; a word that was taken cannot be read again.
SUGAR = (
    (EXTRA_BRUT, r" (?:экстра|extra|ekstra) (?:брют|brut|bryut)(?= )"),
    (BRUT_NATURE, r" (?:брют|brut|bryut) (?:натюр|nature|natyur)(?= )| zero dosage(?= )| dosage zero(?= )| pas dos[eé](?= )"),
    (SEMI_DRY, r" полусух[^ ]*| п сух[^ ]*| polusuh[^ ]*| p suh[^ ]*| semi dry(?= )| demi sec(?= )| halbtrocken(?= )| abboccato(?= )"),
    (SEMI_SWEET, r" полусладк[^ ]*| п сл(?= )| pol[su]*sladk[^ ]*| p sl(?= )| semi sweet(?= )| semidolce(?= )| amabile(?= )| moelleux(?= )| moellyo(?= )| lieblich(?= )"),
    (BRUT, r" (?:брют|brut|bryut)(?= )"),
    (DRY, r" сух(?:ое|ой|ая|ие)?(?= )| suh(?:oe|oy|aya)?(?= )| (?:dry|sec|secco|seco|trocken)(?= )"),
    (SWEET, r" сладк(?:ое|ий|ая|ие)(?= )| sladk(?:oe|iy|aya)(?= )| (?:sweet|dolce|doux|dulce)(?= )"),
)
VINTAGE = r"(?<![\d./-])(19[5-9]\d|20[0-2]\d)(?!\d|[./-]\d)"
CARD_YEAR = r"(?<!\d)((?:19|20)\d\d)(?!\d)"
ABV = r"(?i)(?<![\d.,])(\d{1,2}(?:[.,]\d)?)\s*(?:%|об\b)"
ALC = r"(?i)\balc\.?\s*(\d{1,2}(?:[.,]\d)?)(?![\d.,])"
#: Greek letters that a reader of Cyrillic gives out, Latin letters and digits that look like Cyrillic ones.
GREEK = ("ΑΒΓΔΕΖΗΚΛΜΟΠΡΤΥΦΧαγδεικλμοπρτυφχ", "АВГДЕЗНКЛМОПРТУФХагдеиклмопртуфх")
LOOKS = ("ABCEHKMOPTXYaceopxyu", "АВСЕНКМОРТХУасеорхуи")
LOOK_CAPITALS, LOOK_SMALL, DIGIT_LETTERS = "ABCEHKMOPTXY", "aceopxyu", ("63", "бз")
LEAST_LETTERS = 3
#: Of lines in lower case.
HARVEST, NO_HARVEST = "урожа|vintage|harvest", "основан|since|founded|розлив|bottl|гост"
ABV_MIN, ABV_MAX = 1, 30


def latin(c: Column) -> Column:
    """Lower case, accents gone, Cyrillic in Latin letters, hard and soft signs dropped."""
    out = F.translate(F.translate(F.lower(c), *ACCENTS), *ONE_SIGN)
    for old, new in MANY_SIGNS.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.translate(out, "ъь", "")


def latin_words(text: str) -> list[str]:
    """The words of a constant text in Latin letters, as ``latin`` gives them."""
    return text.translate(str.maketrans(dict(zip(*ONE_SIGN)) | MANY_SIGNS | {"ъ": "", "ь": ""})).split()


def raw_tokens(c: Column) -> Column:
    """Array of the Latin words and numbers of a text."""
    return F.regexp_extract_all(latin(c), F.lit("[a-z0-9]+"), F.lit(0))


def words(c: Column, stop_words: tuple[str, ...] = STOP_WORDS, min_length: int = MIN_TOKEN) -> Column:
    """Distinct words that are long enough, no numbers and no stop words."""
    keep = lambda t: (F.length(t) >= min_length) & ~t.rlike(r"\A\d+\z") & (~t.isin(*stop_words) if stop_words else F.lit(True))
    return F.array_distinct(F.filter(raw_tokens(c), keep))


def phonetic_key(token: Column) -> Column:
    """One spelling for words that sound alike. Meant for distinct tokens, as it is a chain of replacements."""
    for pattern, new in PHONETIC:
        token = F.regexp_replace(token, pattern, new)
    return token


@F.pandas_udf(T.DoubleType())
def difflib_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratio of matching blocks; depends on the order of the arguments."""
    for left, right in pairs:
        yield pd.Series([None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="float64")


def undecided(left: Column, right: Column) -> Column:
    """Whether two different words need the ratio: close in length, long enough, and able to reach the bound at all."""
    a, b = F.length(left), F.length(right)
    return (left != right) & (F.abs(a - b) <= FUZZY_GAP) & (F.least(a, b) >= FUZZY_MIN) & (2.0 * F.least(a, b) / (a + b) >= TOKEN_MATCH)


def decided_similarity(left: Column, right: Column) -> Column:
    """Similarity of pairs that need no ratio: equal, or one is the beginning of a much longer one; else null."""
    a, b = F.length(left), F.length(right)
    begins = F.when(a < b, right.startswith(left)).otherwise(left.startswith(right))
    return F.when(left == right, 1.0).when((F.abs(a - b) > FUZZY_GAP) & (F.least(a, b) >= PREFIX_MIN) & begins, PREFIX_SIMILARITY)


def sugar_levels(c: Column) -> Column:
    """Array of the sugar levels a text names, most special first."""
    text = F.concat(F.lit(" "), F.regexp_replace(F.replace(F.lower(c), F.lit("ё"), F.lit("е")), r"[\s_\-./,;:()«»\"']+", " "), F.lit(" "))
    found = []
    for level, pattern in SUGAR:
        found.append(F.when(text.rlike(pattern), F.lit(level)))
        text = F.regexp_replace(text, pattern, " ")
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def sugar_level(c: Column) -> Column:
    """The one level that a text names; plain brut gives way to a closer kind of brut; two that disagree give null."""
    found = sugar_levels(c)
    only_brut = F.size(F.array_except(found, F.array(*map(F.lit, (BRUT, EXTRA_BRUT, BRUT_NATURE))))) == 0
    left = F.when((F.size(found) > 1) & only_brut, F.array_remove(found, BRUT)).otherwise(found)
    return F.when(F.size(left) == 1, F.get(left, F.lit(0)))


def vintage(c: Column) -> Column:
    """The only year between 1950 and 2029 in a text that is not part of a number or date."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(VINTAGE), F.lit(1)))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)).cast("int"))


def card_year(c: Column) -> Column:
    """The first four digits that begin with 19 or 20."""
    return F.nullif(F.regexp_extract(c, CARD_YEAR, 1), F.lit("")).cast("int")


def alcohol_contents(c: Column) -> Column:
    """Array of the strengths a text prints, between 1 and 30 per cent."""
    numbers = F.transform(F.regexp_extract_all(c, F.lit(ABV), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))
    return F.filter(numbers, lambda x: x.between(ABV_MIN, ABV_MAX))


def line_strengths(c: Column) -> Column:
    """``alcohol_contents`` and the numbers behind ``alc``."""
    numbers = F.transform(F.regexp_extract_all(c, F.lit(ALC), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))
    return F.concat(alcohol_contents(c), F.filter(numbers, lambda x: x.between(ABV_MIN, ABV_MAX)))


def fold_looks(c: Column) -> Column:
    """A reading with look-alike letters in the script they belong to, words joined by single blanks.

    Greek letters become Cyrillic. A word with Cyrillic letters is written in Cyrillic, a lone 3
    beside a letter as З. Other words stay and, from three letters on, may be followed by what
    else they can be: capitals that all look Cyrillic, capitals whose U is a V, small and capital
    look-alikes with a 6 or 3 among them.
    """
    letters = lambda t: F.regexp_replace(t, r"[^\p{L}]", "")

    def word(t: Column) -> Column:
        cyrillic = F.translate(t, *LOOKS)
        lone = F.length(F.regexp_replace(t, r"\D", "")) == 1
        own = F.when(lone, F.regexp_replace(cyrillic, r"(?<=\p{L})3|3(?=\p{L})", "З")).otherwise(cyrillic)
        bare = letters(t)
        upper = (t == F.upper(t)) & (bare != "")
        more = (
            F.when(F.length(bare) < LEAST_LETTERS, None)
            .when(upper & bare.rlike(f"\\A[{LOOK_CAPITALS}]+\\z"), own)
            .when(upper & t.contains("U"), F.translate(t, "U", "V"))
            .when(t.rlike("[63]") & bare.rlike(f"\\A[{LOOK_CAPITALS}{LOOK_SMALL}]+\\z"), F.translate(cyrillic, *DIGIT_LETTERS))
        )
        return F.when(t.rlike(r"[\u0400-\u04ff]"), own).otherwise(F.concat_ws(" ", t, more))

    return F.array_join(F.transform(F.filter(F.split(F.translate(c, *GREEK), r"\s+"), lambda t: t != ""), word), " ")


def stable_hash(c: Column) -> Column:
    """h = 31 h + code of each sign, modulo 2 to the 32."""
    return F.aggregate(F.filter(F.split(c, ""), lambda s: s != ""), F.lit(0).cast("long"), lambda h, s: F.pmod(h * 31 + F.ascii(s), F.lit(4294967296)))
