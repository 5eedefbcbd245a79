"""Several values packed in one string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.functions.text import strip

_OPEN, _CLOSE = "\ue000", "\ue001"
_QUOTE_STARTS = r'(?<![^\s,;|/+&\[{])"'
_QUOTE_ENDS = r'"(?![^\s,;|/+&\]}])'
#: Brackets inside brackets belong to the outer pair, up to this depth.
DEPTH = 8


def _brackets(depth: int = DEPTH) -> str:
    """Pattern of text in round brackets with up to ``depth`` levels."""
    pattern = r"\([^()]*+\)"
    for _ in range(depth - 1):
        pattern = rf"\((?:[^()]++|{pattern})*+\)"
    return pattern


def _bound(c: Column, body) -> Column:
    """``body(c)`` with ``c`` computed once, also where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def _unquoted(span: Column, escapes: bool) -> Column:
    inner = F.substring(span, F.lit(2), F.length(span) - 2)
    inner = F.replace(inner, F.lit('""'), F.lit('"'))
    return F.regexp_replace(inner, r'\\(["\\])', "$1") if escapes else inner


def _values(text: Column, delimiters: str, escapes: bool) -> Column:
    """Array of the values of ``text``.

    1. Protected spans (quoted text, text in round brackets) are cut out and an indexed
       placeholder stands for each. The two placeholder characters are themselves spans, so a
       text that holds them cannot collide with a placeholder.
    2. The rest is split at the delimiters.
    3. Each placeholder is replaced by its span, looked up in the array of spans.
    """
    body = r'(?:[^"\\]++|\\.|"")*+' if escapes else r'(?:[^"]++|"")*+'
    span = f"(?s){_QUOTE_STARTS}{body}{_QUOTE_ENDS}|{_brackets()}|[{_OPEN}{_CLOSE}]"

    def split(spans: Column) -> Column:
        masked = F.array_join(
            F.transform(F.split(text, span, -1), lambda part, i: F.when(i < F.size(spans), F.concat(part, F.lit(_OPEN), i.cast("string"), F.lit(_CLOSE))).otherwise(part)), ""
        )
        pieces = F.filter(F.transform(F.split(masked, delimiters, -1), strip), lambda piece: piece != "")

        def restore(piece: Column) -> Column:
            whole = F.regexp_extract(piece, f"\\A{_OPEN}(\\d+){_CLOSE}\\z", 1)
            alone = F.get(spans, whole.try_cast("int"))
            mixed = F.array_join(
                F.transform(
                    F.split(piece, _OPEN, -1),
                    lambda part, j: F.when(j == 0, part).otherwise(
                        F.concat(F.get(spans, F.substring_index(part, _CLOSE, 1).try_cast("int")), F.regexp_replace(part, f"(?s)\\A[^{_CLOSE}]*{_CLOSE}", ""))
                    ),
                ),
                "",
            )
            return strip(F.when((whole != "") & alone.startswith('"'), _unquoted(alone, escapes)).otherwise(mixed))

        return F.filter(F.transform(pieces, restore), lambda value: value != "")

    return _bound(F.regexp_extract_all(text, F.lit(span), F.lit(0)), split)


def packed_values(c: Column, separators: str = ",;|/+&\t\r\n", words: tuple[str, ...] = ("и", "and", "und", "et")) -> Column:
    """Array of the values in ``c``, in order; null and blank give null.

    Forms: ``["a", "b"]`` and ``{a,"b c"}`` (only the comma separates), else any of
    ``separators`` or one of ``words`` standing alone. Quoted text and text in round brackets
    (also nested, see ``DEPTH``) is never split; the quotes around a value go, doubled (and in the first two forms escaped)
    quotes inside become plain ones. A quote that does not stand at the start of a value, or is
    never closed, is ordinary text.
    """
    text = strip(c)
    boxed = text.rlike(r"(?s)\A(?:\[.*\]|\{.*\})\z")
    inside = F.substring(text, F.lit(2), F.length(text) - 2)
    anywhere = "[" + separators.replace("\t", "\\t").replace("\r", "\\r").replace("\n", "\\n") + "]|(?iU)(?<=\\s)(?:" + "|".join(words) + ")(?=\\s)"
    return F.when(text == "", None).when(boxed, _values(inside, ",", True)).otherwise(_values(text, anywhere, False))


def explode_packed(df: DataFrame, key: str, packed: str, value: str, **options) -> DataFrame:
    """One row per value: ``key``, ``pos`` (from 1, over non-blank values) and ``value``.

    Null and blank strings give no row; repeated values and repeated rows are kept. Other
    columns, whatever their names, are not read.
    """
    return (
        df.select(F.col(key).alias("__key"), packed_values(F.col(packed), **options).alias("__values"))
        .select("__key", F.posexplode("__values").alias("__pos", "__value"))
        .select(F.col("__key").alias(key), (F.col("__pos") + 1).alias("pos"), F.col("__value").alias(value))
    )
