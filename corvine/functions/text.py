"""Text expressions built from JVM functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that only say that a value is unknown (compared in lower case, trimmed).
FILLERS = (
    "-", "--", "—", "–", "?", "??", "???", ".", "...", "…",
    "n/a", "na", "n.a.", "none", "nan", "null", "nil", "tbd", "tba", "unknown", "undefined", "not specified", "no data", "not available",
    "не указано", "не указан", "не указана", "неизвестно", "неизвестен", "неизвестна", "нет данных", "нет", "н/д", "нд", "без данных", "не определено", "уточняется",
    "unbekannt", "keine angabe", "k. a.", "inconnu", "inconnue", "non renseigné",
)


#: Unicode white space.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Trim every Unicode white-space character, as Python's ``str.strip`` does."""
    return F.btrim(c, F.lit(BLANKS))


def clean(c: Column) -> Column:
    """Trimmed text; blank becomes null."""
    return F.nullif(strip(c), F.lit(""))


def is_real(c: Column) -> Column:
    """True if the text holds a value: not null, not blank, not a filler. Never null."""
    return F.coalesce(~F.lower(clean(c)).isin(*FILLERS), F.lit(False))


def slug_key(c: Column) -> Column:
    """Slugs are the same if their keys are: case, surrounding blanks and kind and number of separators do not count. Blank gives null."""
    return F.regexp_replace(F.lower(clean(c)), "[-_]+", "-")


def media_stem(c: Column) -> Column:
    """File name without folder, extension and upload suffix (``_`` and ten hexadecimal digits)."""
    name = F.regexp_replace(strip(c), r"(?s)\A.*[/\\]", "")
    return F.regexp_replace(F.regexp_replace(name, r"(?s)\.[^.]*\z", ""), r"_[0-9a-fA-F]{10}\z", "")


def picture_key(c: Column) -> Column:
    """Letters and digits of the stem in lower case. Null for null and blank names."""
    return F.when(clean(c).isNotNull(), F.regexp_replace(F.lower(media_stem(c)), r"[^\p{L}\p{N}]", ""))
