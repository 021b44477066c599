"""Helpers that the corpus operators share: shared storage, samples of labelled rows, Arrow mapping."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")  # a word of every word-based operator
WORD_SQL = r"[^\x20\x09-\x0D]+"
GAP_SQL = r"[\x20\x09-\x0D]+"

_own: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; a local one only where that setting is absent (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = _own.setdefault("dir", tempfile.mkdtemp(prefix="spark-checkpoints-", dir="/tmp"))
        base = f"file://{base}"
    folder = f"{base.rstrip('/')}/tabspark-{uuid.uuid4().hex}"

    def drop(jvm=spark._jvm, conf=spark._jsc.hadoopConfiguration()) -> None:
        try:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
        except Exception:  # the JVM may be gone by now
            pass

    atexit.register(drop)
    return folder


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it: cuts lineage, outlives lost executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, folder: str, name: str) -> DataFrame:
    """A table that is scanned again and again, dealt anew if its files make fewer partitions than there are cores (then
    it is small)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else stored(df.repartition(cores), folder, name)


def map_texts(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: "str | T.StructType") -> DataFrame:
    """``fn`` over the Arrow batches of each task. Workers outlive their stage, and their allocators keep what they had,
    so a task begins and ends by giving back what is free."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return what this process has freed to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4_000_000, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one slice holds about ``limit`` bytes of ``column``, or one row if that row is longer."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        at = 0
        while at < batch.num_rows:
            to, size = at, 0
            while to < batch.num_rows and to - at < rows and (to == at or size < limit):
                value = texts[to]
                size += len(value.as_buffer() or b"") if value.is_valid else 0
                to += 1
            yield batch.slice(at, to - at)
            at = to


def split_of(column: str, buckets: int) -> "F.Column":
    """crc32 of the id as text, modulo ``buckets``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % buckets


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: "F.Column", per_class: int) -> DataFrame:
    """(doc_id, text, label) of at most about ``per_class`` labelled rows of each class, chosen by a hash of the id.

    ``learn`` says, over the column doc_id, which rows may be learned from. The two counts that set the shares are
    the only things that come to the driver. The ids are bounded by 2 * per_class, so they are broadcast.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("label") == 1, F.lit(per_class / max(1, counts.get(1, 0)))).otherwise(F.lit(per_class / max(1, counts.get(0, 0))))
    place = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    chosen = known.filter(place < share)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
