"""The abuse classifier over a corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvine.llm.abuse import THRESHOLD, Classifier, train
from corvine.session import ship_package

#: Labelled texts that training takes at most; beyond it a fixed sample by the hash of the id.
MAX_LABELLED = 20_000

_MODELS: dict[int, Classifier] = {}


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Classifier:
    """Trained on the driver from at most ``max_labelled`` labelled texts.

    ``labels``: doc_id, annotator, toxic. Repeated lines of one annotator count once; a null
    label is none; labels of documents that do not exist or have no text are left out.
    """
    votes = (
        labels.where(F.col("toxic").isNotNull())
        .groupBy("doc_id", "annotator")
        .agg(F.max("toxic").alias("toxic"))
        .groupBy("doc_id")
        .agg(F.avg("toxic").alias("share"), F.count("*").alias("judges"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    # at most max_labelled rows, so the texts of the corpus are not shuffled
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(votes), "doc_id")
    rows = sorted(texts.collect(), key=lambda r: (r.doc_id, r.text))
    return train([(r.text, r.share, r.judges) for r in rows])


def score_documents(documents: DataFrame, model: Classifier, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns of ``keep`` and ``score`` (probability of the worst sentence) of every row; 0 for null, empty and wordless texts."""
    spark = documents.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        key = hash((weights.tobytes(), bias))
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = Classifier(weights, bias)
        judge = _MODELS[key]
        for batch in batches:
            scores = pa.array([judge.score(text) for text in batch.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], scores], names=["doc_id", *keep, "score"])

    schema = T.StructType([documents.schema["doc_id"], *(documents.schema[c] for c in keep), T.StructField("score", T.DoubleType())])
    return documents.select("doc_id", "text", *keep).mapInArrow(run, schema)


def rates(documents: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """source, n_docs, n_abusive, rate of each source (null is a source of its own). Repeated rows count as rows."""
    scored = score_documents(documents, model, ("source",))
    return (
        scored.groupBy("source")
        .agg(F.count("*").alias("n_docs"), F.count_if(F.col("score") >= threshold).alias("n_abusive"))
        .withColumn("rate", F.round(F.col("n_abusive") / F.col("n_docs"), 6))
    )
