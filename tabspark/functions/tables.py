"""Table functions (F4): the sequential solvers and batch inference, called from SQL over a table.

``register(spark)`` makes them known as ``smooth_starts``, ``leader_clusters`` and ``predict``. The solvers say themselves
how their table is dealt (by score or run), so a call is ``SELECT * FROM smooth_starts(TABLE(labels))``.
"""

from __future__ import annotations

import importlib

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf

from ..operators import seq as W


def _types(rows: AnalyzeArgument, *names: str) -> list[T.StructField]:
    if not rows.isTable:
        raise ValueError("the first argument is a table")
    missing = [n for n in names if n not in rows.dataType.names]
    if missing:
        raise ValueError(f"columns needed: {', '.join(missing)}")
    return [T.StructField(n, rows.dataType[n].dataType) for n in names]


class _Whole:
    """Gathers one partition of the table (one score or run) and gives it to ``solve`` as a frame."""

    def __init__(self):
        self.rows = []

    def eval(self, row):
        self.rows.append(row.asDict())

    def terminate(self):
        if self.rows:
            out = self.solve(pd.DataFrame(self.rows)).astype(object)
            yield from out.where(out.notna(), None).itertuples(index=False, name=None)


class SmoothStarts(_Whole):
    """W23 over labels (score_id, frame_id, t, index, value, conf)."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        own = _types(rows, "score_id", "frame_id", "t", "index", "value", "conf")
        return AnalyzeResult(T.StructType([*own[:2], T.StructField("start_measure", T.IntegerType()), T.StructField("confidence", T.DoubleType())]), partitionBy=[PartitioningColumn("score_id")], orderBy=[OrderingColumn("t"), OrderingColumn("frame_id")])

    def eval(self, row):
        self.rows.append(tuple(row[n] for n in ("score_id", "frame_id", "t", "index", "value", "conf")))

    def terminate(self):
        if self.rows:
            yield from ((self.rows[0][0], *r) for r in W.starts_of(r[1:] for r in self.rows))


class LeaderClusters(_Whole):
    """W24 over glyphs (run_id, ord, feature), with a threshold."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, threshold: AnalyzeArgument) -> AnalyzeResult:
        own = _types(rows, "run_id", "ord", "feature")
        return AnalyzeResult(T.StructType([*own[:2], T.StructField("cluster_id", T.IntegerType()), T.StructField("distance", T.DoubleType())]), partitionBy=[PartitioningColumn("run_id")], orderBy=[OrderingColumn("ord")])

    def eval(self, row, threshold):
        self.threshold = float(threshold)
        super().eval(row)

    def solve(self, frame: pd.DataFrame) -> pd.DataFrame:
        return W.clusters_of(frame, self.threshold)


class Predict:
    """F1 over any table: ``model`` names (module:function) what makes a model, once in each worker; the model turns a
    frame of up to ``batch`` rows into a frame, whose columns are those of the StructType ``schema`` of its maker."""

    made: dict = {}

    @staticmethod
    def maker(name: str):
        module, _, function = name.partition(":")
        return getattr(importlib.import_module(module), function)

    @staticmethod
    def analyze(rows: AnalyzeArgument, model: AnalyzeArgument, batch: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not model.isConstantExpression or not batch.isConstantExpression:
            raise ValueError("predict(TABLE(rows), 'module:function', batch)")
        return AnalyzeResult(Predict.maker(model.value).schema)

    def __init__(self):
        self.rows = []

    def _out(self):
        frame = self.made[self.name](pd.DataFrame(self.rows))
        self.rows = []
        yield from frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None) if len(frame) else ()

    def eval(self, row, model, batch):
        self.name = model
        if model not in self.made:
            self.made[model] = self.maker(model)()
        self.rows.append(row.asDict())
        if len(self.rows) >= batch:
            yield from self._out()

    def terminate(self):
        if self.rows:
            yield from self._out()


def register(spark: SparkSession) -> None:
    for name, kind in (("smooth_starts", SmoothStarts), ("leader_clusters", LeaderClusters), ("predict", Predict)):
        spark.udtf.register(name, udtf(kind))
