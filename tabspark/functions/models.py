"""Batch inference (F1, F2): a model is made once in each Python worker and gets Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import ctc_decode


def predict(df: DataFrame, make_model: Callable, schema: str, batch: int = 64) -> DataFrame:
    """``make_model()`` gives a function from a pandas frame to a pandas frame (any number of rows)."""

    def run(frames):
        model = make_model()
        for f in frames:
            for i in range(0, len(f), batch):
                yield model(f.iloc[i : i + batch])

    return df.mapInPandas(run, schema)


def read_text(df: DataFrame, logits: str, characters: str) -> DataFrame:
    """text and confidence of the model's outputs, decoded in built-in expressions."""
    return df.withColumn("_d", ctc_decode(F.col(logits), characters)).select(*df.columns, "_d.text", "_d.confidence")


def accept_prediction(text: Column, confidence: Column, least: float = 0.0, most: int = 36) -> Column:
    """one or two digits within the range and enough confidence."""
    return F.coalesce(text.rlike(r"^\d{1,2}$") & (text.try_cast("int") <= most) & (confidence >= least), F.lit(False))


def decode_detections(df: DataFrame, labels: list[str], least: float = 0.35) -> DataFrame:
    """Detector output (batch_id, counts, boxes of class, score, x1, y1, x2, y2) as rows for each image of the
    batch: the n-th image owns the boxes after the counts before it. Corners become x, y, w, h."""
    ends = F.transform("counts", lambda c, i: F.aggregate(F.slice("counts", F.lit(1), i + 1), F.lit(0), lambda s, x: s + x))
    rows = df.withColumn("_e", ends).select("batch_id", "_e", F.posexplode("boxes").alias("ix", "b"))
    image = F.size(F.filter("_e", lambda e: e <= F.col("ix")))
    return rows.filter(F.col("b")[1] >= least).select("batch_id", image.alias("image_ix"), "ix", F.get(F.array(*map(F.lit, labels)), F.col("b")[0].cast("int")).alias("label"), F.col("b")[1].alias("score"), F.col("b")[2].alias("x"), F.col("b")[3].alias("y"), (F.col("b")[4] - F.col("b")[2]).alias("w"), (F.col("b")[5] - F.col("b")[3]).alias("h"))
