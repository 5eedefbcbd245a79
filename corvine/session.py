"""Session construction and the few run-time services every operator shares."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "corvine", master: str | None = None, cores: int = 8) -> SparkSession:
    """A session with adaptive execution, skew-join splitting, UTC and Arrow on.

    On a cluster leave ``master`` unset; the submit command decides.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``. Where none is named a local session (tests) takes a temporary one; on a cluster, whose machines share no temporary folder, RuntimeError."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = context.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        configured = "file://" + os.path.join(tempfile.gettempdir(), "corvine-checkpoints")
    context.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared checkpoint folder and return that table, without the lineage of ``df``. Compressed by zstd, as these tables stay until the session ends, and computed once (an eager checkpoint computes its last stage twice)."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    # what was shuffled for it is deleted once the driver has collected its garbage
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the tables of ``cut`` that ``df`` reads. Nothing that is still to be computed may need them."""
    jvm = df.sparkSession.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.rsplit("/", 1)[-1].startswith("cut-"):
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers of this session the package, wherever the driver imported it from. Done once a session."""
    context = spark.sparkContext
    if getattr(context, "_corvine_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="corvine-")) / "corvine.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._corvine_shipped = True
