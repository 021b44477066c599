"""Hard-negative mining: inner products in a residue number system, then a window of scores for each positive.

Vectors are whole numbers. They are reduced modulo small primes, multiplied as float32 matrices in which every sum stays
below 2**24 and so is exact, and the residues of a score are put together by Chinese remaindering; the number of primes
follows from a bound on the scores. Anchors go out in blocks of a weighed size, each a broadcast and two passes over all
rows: the first finds each anchor's positives, the second the negatives inside their windows. Every partition hands on
its best few of each anchor only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir

COLUMNS = 64  # of one float32 product: 64 * 510**2 < 2**24
PRIMES = [p for p in range(1021, 2, -1) if all(p % q for q in range(2, math.isqrt(p) + 1))]  # residues are at most 510
BLOCK = 8_000_000  # bytes of anchors in one broadcast
TILE = (256, 10_000)  # anchors and rows multiplied at a time
LONG = 2**63 - 1


def usable(rows: DataFrame, relabel: int = 7, labels: int = 10) -> DataFrame:
    """(vec_id, label, embedding) of rows with a label and finite components, every ``relabel``-th id's label moved on."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % relabel == 0, (label + 1) % labels).otherwise(label)
    return rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(~bad).select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), "embedding")


def matrix(embeddings: pa.Array) -> np.ndarray:
    """Vectors as rows of whole float64 numbers; shorter ones are filled with zeros."""
    embeddings = embeddings.combine_chunks() if isinstance(embeddings, pa.ChunkedArray) else embeddings
    sizes = np.diff(embeddings.offsets.to_numpy())
    values = np.floor(256.0 * embeddings.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def residues(x: np.ndarray, p: int) -> np.ndarray:
    r = np.fmod(x, p)
    return np.where(r > p // 2, r - p, np.where(r < -(p // 2), r + p, r)).astype(np.float32)


def _norm(x: np.ndarray) -> int:
    """No less than the Euclidean norm of any row."""
    if not x.size:
        return 1
    top = float(np.abs(x).max())
    return 1 if not top else int(math.ceil(top) * math.ceil(math.sqrt(float(np.square(x / top).sum(1).max())) * 1024 + 1) // 1024 + 1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of ``a`` and ``b``, exact: int64, or Python integers where a score may pass 2**61."""
    columns = min(a.shape[1], b.shape[1])  # what one side lacks is zero
    a, b = a[:, :columns], b[:, :columns]
    bound, primes, whole = _norm(a) * _norm(b), [], 1
    while whole <= 2 * bound + 1:
        primes.append(PRIMES[len(primes)])
        whole *= primes[-1]
    kind = np.int64 if whole < 2**62 else object
    total, weight = np.zeros((len(a), len(b)), kind), 1  # mixed radix: total is right modulo weight
    for p in primes:
        ra, rb = residues(a, p), residues(b, p)
        rest = np.zeros((len(a), len(b)), np.int64)
        for c in range(0, columns, COLUMNS):
            rest += (ra[:, c : c + COLUMNS] @ rb[:, c : c + COLUMNS].T).astype(np.int64)
        digit = (rest - (total % p).astype(np.int64)) % p * pow(weight, -1, p) % p
        total += digit.astype(kind) * weight
        weight *= p
    return np.where(total > whole // 2, total - whole, total)


def _best(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's ``k`` best allowed scores, earlier columns first among equals; -1 where there are fewer."""
    n = scores.shape[1]
    if not n:
        return np.full((len(scores), k), -1)
    if scores.dtype == object or int(np.abs(scores).max(initial=0)) >= 2**62 // n:
        order = np.lexsort((np.broadcast_to(np.arange(n), scores.shape), -scores, ~allowed), axis=-1) if scores.dtype != object else np.array(
            [sorted(range(n), key=lambda j: (not ok[j], -row[j], j)) for row, ok in zip(scores, allowed)]).reshape(scores.shape)
    else:
        key = np.where(allowed, scores * n + np.arange(n - 1, -1, -1), -LONG)
        order = np.argpartition(key, n - k, axis=-1)[:, n - k :] if k < n else np.broadcast_to(np.arange(n), scores.shape)
        order = np.take_along_axis(order, np.argsort(-np.take_along_axis(key, order, -1), axis=-1), -1)
    order = np.where(np.take_along_axis(allowed, order, -1), order, -1)[:, :k]
    return np.pad(order, ((0, 0), (0, k - order.shape[1])), constant_values=-1)


class _Top:
    """The best few rows seen so far for each of some keys: score descending, then id ascending, null last."""

    def __init__(self, keys: int, k: int):
        self.k, self.scores, self.ids, self.state = k, np.zeros((keys, k), object), np.zeros((keys, k), np.int64), np.full((keys, k), 2, np.int8)  # state: 0 id, 1 null id, 2 nothing

    def add(self, keys: np.ndarray, scores: np.ndarray, places: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        got = np.take_along_axis(scores, np.maximum(places, 0), -1).astype(object)
        state = np.where(places < 0, 2, nulls[np.maximum(places, 0)]).astype(np.int8)
        scores, ids, state = np.hstack([self.scores[keys], got]), np.hstack([self.ids[keys], ids[np.maximum(places, 0)]]), np.hstack([self.state[keys], state])
        rank = -scores if any(abs(x) > LONG for x in (scores.min(), scores.max())) else -scores.astype(np.int64)
        if rank.dtype == object:
            order = np.array([sorted(range(len(r)), key=lambda j: (s[j] == 2, r[j], s[j], i[j])) for r, s, i in zip(rank, state, ids)])
        else:
            order = np.lexsort((ids, state, rank, state == 2), axis=-1)
        for name, x in (("scores", scores), ("ids", ids), ("state", state)):
            getattr(self, name)[keys] = np.take_along_axis(x, order[:, : self.k], -1)

    def table(self) -> tuple[np.ndarray, dict[str, pa.Array]]:
        key, place = np.nonzero(self.state < 2)
        scores = [max(-LONG - 1, min(LONG, int(x))) for x in self.scores[key, place]]
        return key, {"id": pa.array(self.ids[key, place], pa.int64(), mask=self.state[key, place] == 1), "score": pa.array(scores, pa.int64())}


def _tiles(batches: Iterator[pa.RecordBatch], anchors: np.ndarray, tile: tuple[int, int]) -> Iterator[tuple]:
    """(slice of anchors, scores, ids, null flags, labels) of blocks of rows in the order of their ids."""
    for batch in batches:
        for at in range(0, batch.num_rows, tile[1]):
            part = batch.slice(at, tile[1])
            nulls = np.asarray(part.column("vec_id").is_null())
            ids = part.column("vec_id").fill_null(0).to_numpy(zero_copy_only=False)
            order = np.lexsort((ids, nulls))
            part, ids, nulls = part.take(pa.array(order)), ids[order], nulls[order].astype(np.int64)
            rows, labels = matrix(part.column("embedding")), part.column("label").to_numpy(zero_copy_only=False)
            for a in range(0, len(anchors), tile[0]):
                yield np.arange(a, min(a + tile[0], len(anchors))), products(anchors[a : a + tile[0]], rows), ids, nulls, labels


def _positives(block: object, k: int, tile: tuple[int, int]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor_ids, anchor_labels, anchors = block.value
        top = _Top(len(anchor_ids), k)
        for these, scores, ids, nulls, labels in _tiles(batches, anchors, tile):
            allowed = (anchor_labels[these, None] == labels) & ((anchor_ids[these, None] != ids) | (nulls == 1))
            top.add(these, scores, _best(scores, allowed, k), ids, nulls)
        key, out = top.table()
        yield pa.RecordBatch.from_pydict({"a": pa.array(key, pa.int64()), **out})

    return find


def _negatives(block: object, positives: object, k: int, low: int, high: int, tile: tuple[int, int]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor_ids, anchor_labels, anchors = block.value
        owner, scores_of = positives.value  # sorted by owner
        least = np.array([-(-low * s // 100) for s in scores_of.tolist()], object)
        most = np.array([high * s // 100 for s in scores_of.tolist()], object)
        top = _Top(len(owner), k)
        for these, scores, ids, nulls, labels in _tiles(batches, anchors, tile):
            other = anchor_labels[these, None] != labels
            some = np.arange(*np.searchsorted(owner, [these[0], these[-1] + 1]))
            if not len(some):
                continue
            limit = (np.clip(least[some], -LONG, LONG).astype(np.int64), np.clip(most[some], -LONG, LONG).astype(np.int64)) if scores.dtype != object else (least[some], most[some])
            row = owner[some] - these[0]
            for c in range(0, len(some), tile[0]):
                r, own = row[c : c + tile[0]], scores[row[c : c + tile[0]]]
                allowed = (other[r] & (own >= limit[0][c : c + tile[0], None]) & (own <= limit[1][c : c + tile[0], None])).astype(bool)
                top.add(some[c : c + tile[0]], own, _best(own, allowed, k), ids, nulls)
        key, out = top.table()
        yield pa.RecordBatch.from_pydict({"p": pa.array(key, pa.int64()), "a": pa.array(owner[key], pa.int64()), **out})

    return find


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of hard negatives.

    Anchors are the usable rows whose id is divisible by ``every``. Rows without a label or vector, or with a null or
    non-finite component, take no part. A row without an id can be a partner and comes last among equal scores. Repeated
    rows are partners one by one; an anchor's own id is never its partner, equal anchors are one, and anchors of one id
    with other labels or vectors are mined each by itself. Components that a shorter vector lacks are zero. Scores beyond
    the range of a long count as its ends. Extra columns are not read; empty tables give no rows. The anchors come to
    the driver a block at a time.
    """
    spark, folder = rows.sparkSession, shared_dir(rows.sparkSession)
    pool = usable(rows)
    anchors = pool.filter(F.col("vec_id") % every == 0).distinct()
    n, wide = anchors.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    blocks = max(1, -(-n * (8 * wide + 64) // BLOCK))
    best = lambda key, k: F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), F.asc_nulls_last("id"))) <= k
    for k in range(blocks):
        part = anchors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == k).toArrow()
        ids = part["vec_id"].to_numpy()
        block = spark.sparkContext.broadcast((ids, part["label"].to_numpy(), matrix(part["embedding"])))
        near = pool.mapInArrow(_positives(block, positives, TILE), "a long, id long, score long")
        near = near.withColumn("best", best("a", positives)).filter("best").drop("best").toArrow().sort_by([("a", "ascending"), ("score", "descending"), ("id", "ascending")])
        found = spark.sparkContext.broadcast((near["a"].to_numpy(), near["score"].to_numpy()))
        names = spark.createDataFrame(pa.table({"p": pa.array(np.arange(len(near))), "anchor_id": pa.array(ids[near["a"].to_numpy()], pa.int64()), "positive_id": near["id"], "positive_score": near["score"]}))
        rank = F.row_number().over(Window.partitionBy("p").orderBy(F.desc("score"), F.asc_nulls_last("id")))
        far = pool.mapInArrow(_negatives(block, found, negatives, low, high, TILE), "p long, a long, id long, score long").withColumn("rank", rank).filter(f"rank <= {int(negatives)}")
        out = far.join(F.broadcast(names), "p").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.write.mode("append").parquet(f"{folder}/negatives")
    return spark.read.schema(out.schema).parquet(f"{folder}/negatives")
