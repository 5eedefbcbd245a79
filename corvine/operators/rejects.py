"""Load lines that parse, set the others apart with the reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.functions.text import clean, strip

_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_BARE = r'(?!")[^,]*+'
#: A cell after its comma, directly behind the cell before.
_CELL = f"\\G,({_QUOTED}|{_BARE})"


@dataclass(frozen=True)
class LineFormat:
    """Columns of one kind of file and the condition its values must meet (a function of column -> Column)."""

    kind: str
    columns: tuple[str, ...]
    valid: object


def _slug_ok(cell) -> Column:
    return strip(cell("slug")).rlike(r"\A[a-z0-9_-]+\z")


CATALOG = LineFormat("catalog", ("name", "category", "color", "region", "grape_varieties", "description", "winery", "slug", "source_image_filename"), _slug_ok)
OVERRIDES = LineFormat(
    "overrides",
    ("slug", "action", "strapi_filename", "note"),
    lambda cell: _slug_ok(cell)
    & strip(cell("action")).isin("set", "reject", "confirm")
    & ((strip(cell("action")) != "set") | clean(cell("strapi_filename")).isNotNull()),
)
FORMATS = (CATALOG, OVERRIDES)


def _cells(line: Column) -> Column:
    """The raw cells from the left up to the first one that is broken. The line's cells are whole iff joining them gives the line."""
    return F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CELL), F.lit(1))


def _plain(raw: Column) -> Column:
    return F.when(raw.startswith('"'), F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit('"'))).otherwise(raw)


def read_lines(df: DataFrame, formats: tuple[LineFormat, ...] = FORMATS) -> DataFrame:
    """Records of ``df`` (rec_id, file_kind, line_no, raw_line) with their cells and the three checks; headers and blank lines are gone."""
    line = F.regexp_replace(F.coalesce("raw_line", F.lit("")), r"\r?\n?\z", "")
    parsed = df.where(~F.coalesce(F.col("line_no") == 1, F.lit(False))).select("rec_id", "file_kind", "raw_line", line.alias("line"))
    parsed = parsed.withColumn("raw_cells", _cells(F.col("line")))
    parsed = parsed.withColumn("quoting_ok", F.array_join("raw_cells", ",") == F.col("line"))
    parsed = parsed.withColumn("cells", F.transform("raw_cells", _plain))
    blank = F.col("quoting_ok") & F.forall("cells", lambda c: strip(c) == "")
    width, valid = F.lit(None).cast("int"), F.lit(None).cast("boolean")
    for fmt in formats:
        here = F.col("file_kind") == fmt.kind
        width = F.when(here, len(fmt.columns)).otherwise(width)
        valid = F.when(here, fmt.valid(lambda name, fmt=fmt: F.get(F.col("cells"), F.lit(fmt.columns.index(name))))).otherwise(valid)
    return parsed.where(~blank).select(
        "rec_id", "file_kind", "raw_line", "cells", "quoting_ok", F.coalesce(F.size("cells") == width, F.lit(False)).alias("width_ok"), F.coalesce(valid, F.lit(False)).alias("valid")
    )


def conforming(records: DataFrame) -> DataFrame:
    """The strict load: records with whole quoting, the right number of cells and valid values."""
    return records.where(F.col("quoting_ok") & F.col("width_ok") & F.col("valid"))


def load_kind(df: DataFrame, fmt: LineFormat) -> DataFrame:
    """The valid rows of one kind of file as columns, beside rec_id."""
    records = conforming(read_lines(df.where(F.col("file_kind") == fmt.kind), (fmt,)))
    return records.select("rec_id", *(F.get("cells", F.lit(i)).alias(name) for i, name in enumerate(fmt.columns)))


def rejected_lines(df: DataFrame, formats: tuple[LineFormat, ...] = FORMATS) -> DataFrame:
    """``rec_id`` and ``reason`` of every record that the strict load leaves out.

    The offsets (rec_id and a hash of the line, so that a repeated rec_id with another line
    counts on its own) of the conforming rows are subtracted from all offsets by an anti-join;
    what remains is diagnosed: bad_quoting, else column_count, else invalid_value.

    Null lines and lines of blank cells are no records; a null or unknown file_kind has no known
    width and gives column_count; a null line_no is a record. An empty table gives no row.
    """
    records = read_lines(df, formats)
    offsets = records.withColumn("offset_hash", F.xxhash64("file_kind", "raw_line"))
    loaded = conforming(records).select(F.col("rec_id").alias("ok_id"), F.xxhash64("file_kind", "raw_line").alias("ok_hash"))
    rest = offsets.select("rec_id", "offset_hash", "quoting_ok", "width_ok").join(
        loaded, F.col("rec_id").eqNullSafe(F.col("ok_id")) & (F.col("offset_hash") == F.col("ok_hash")), "left_anti"
    )
    reason = F.when(~F.col("quoting_ok"), "bad_quoting").when(~F.col("width_ok"), "column_count").otherwise("invalid_value")
    return rest.select("rec_id", reason.alias("reason"))
