"""Readers and writers of the file formats around the catalogue."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvine.functions.text import clean


def _strings(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_table_text(spark: SparkSession, path: str, columns: dict[str, str], sep: str = ",", multi_line: bool = True) -> DataFrame:
    """A delimited file with a header: ``columns`` maps each required header (trimmed, without byte-order mark) to its new name.

    A missing header raises ValueError; values are trimmed and blanks become null; a quoted value may span lines.
    With that a file is read by one task; where no value does, ``multi_line`` false splits large files.
    """
    raw = spark.read.option("header", True).option("sep", sep).option("multiLine", multi_line).option("escape", '"').csv(path)
    names = {c.lstrip("﻿").strip(): c for c in raw.columns}
    missing = [c for c in columns if c not in names]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return raw.select(*(clean(F.col(f"`{names[old]}`")).alias(new) for old, new in columns.items()))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines by an explicit schema; a line that does not parse fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_zip_members(spark: SparkSession, path: str) -> DataFrame:
    """path, member and content of every member of the ZIP files under ``path``, without directories and system entries; names stored without the UTF-8 flag are repaired where they are UTF-8."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for info in archive.infolist():
                        member = info.filename
                        if not info.flag_bits & 0x800:
                            try:
                                member = member.encode("cp437").decode("utf-8")
                            except UnicodeError:
                                pass
                        base = member.rsplit("/", 1)[-1]
                        if info.is_dir() or member.startswith("__MACOSX/") or base.startswith("._") or base == ".DS_Store":
                            continue
                        yield pd.DataFrame({"path": [name], "member": [member], "content": [archive.read(info)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, member string, content binary")


def content_key(content: str = "content"):
    """The address of a blob: its SHA-256 in hexadecimal."""
    return F.sha2(F.col(content), 256)


def append_version(df: DataFrame, path: str, run: int) -> None:
    """Append rows of one run to a table partitioned by run."""
    df.withColumn("run_id", F.lit(run)).write.mode("append").partitionBy("run_id").parquet(path)


def publish(df: DataFrame, path: str) -> None:
    """Put the rows of ``df`` in the place of the table at ``path``: written beside it, then renamed, so that a reader finds the old or the new rows whole, and a run that fails leaves the old ones. ``df`` may read ``path``."""
    spark, fresh = df.sparkSession, f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    to_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, old = to_path(path), to_path(f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(to_path(fresh), target):
        raise OSError(f"cannot publish {path}")
    fs.delete(old, True)


def replace_table(df: DataFrame, path: str) -> None:
    """Full refresh of a table in one step."""
    publish(df, path)


def prune(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """The rows of the archives to keep; rows of no archive go as well."""
    return df.where(F.col(column).isin(*keep))


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """A small report in one file."""
    getattr(df.coalesce(1).write.mode("overwrite").option("header", True), kind)(path)


def tolerant_json(text: str, schema: str):
    """The parsed record, or null where the text is no such record."""
    return F.from_json(F.col(text), schema, {"mode": "PERMISSIVE"})


def recorded_run(df: DataFrame, table: str, log: str, run: int, version: str, announce: bool = False) -> bool:
    """One import run: nothing to do if the last succeeded run has the same version; else the rows go to a path of their own, and only a run that wrote them all is logged as succeeded.

    With ``announce`` the log gets a row ``running`` at the start. A failed run is logged with its error and leaves the state as it was. Returns whether rows were written.
    """
    spark = df.sparkSession
    schema = "run long, version string, path string, status string, error string"
    try:
        runs = spark.read.schema(schema).json(log)
        last = runs.where("status = 'succeeded'").agg(F.max_by("version", "run").alias("v")).first()
        if last and last.v == version:
            return False
    except Exception as missing:  # no log yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    path, error = f"{table.rstrip('/')}/run={run}", None
    note = lambda status, text: spark.createDataFrame([(run, version, path, status, text)], schema).coalesce(1).write.mode("append").json(log)
    if announce:
        note("running", None)
    try:
        df.write.mode("overwrite").parquet(path)
    except Exception as failed:
        error = str(failed)[:500]
        raise
    finally:
        note("failed" if error else "succeeded", error)
    return True
