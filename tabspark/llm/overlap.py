"""Benchmark decontamination: windows of test items, as a broadcast set of hashes, looked for in whole documents.

The windows are normalised and made by Spark, weighed, and dealt into blocks of at most about ``BLOCK`` bytes by their
hash; each block is one broadcast and one pass over the texts, so a benchmark of any size is searched for in full and
none is broadcast unweighed (one block in practice). A pass hands the spans and items found so far to the next, without
a shuffle. Every hash hit is confirmed word by word.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of lower-cased text
TABLE = bytes(ord(LOWER[i - 65]) if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256))
BREAK = b"\xff"  # no byte of UTF-8: parts documents
BLOCK = 32_000_000  # bytes of windows in one broadcast
BASE = np.uint64(0x9E3779B97F4A7C15)  # of the polynomial hash, odd
COARSE = 20  # bits of the hash that a first look takes


def windows(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Distinct (item, window, m): all runs of ``size`` words of an item, or all its words if they are fewer. Items
    without words have none; an item without an id has windows and a null ``item``; rows of one id are one item."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), F.expr(f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), r'{WORD_SQL}', 0)").alias("ws")).filter("size(ws) > 0")
    starts = words.select("item", "ws", F.explode(F.sequence(F.lit(1), F.greatest(F.size("ws") - (size - 1), F.lit(1)))).alias("i"))
    return starts.select("item", F.array_join(F.slice("ws", F.col("i"), F.lit(size)), " ").alias("window"), F.least(F.size("ws"), F.lit(size)).alias("m")).distinct()


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


class Index:
    """The windows of one block: numbers of their words and, by length, their hashes in order with words and items."""

    def __init__(self, table: pa.Table):
        self.vocabulary = _Vocabulary({BREAK: -1})
        items: dict[int, dict[tuple[int, ...], list[str]]] = defaultdict(lambda: defaultdict(list))
        for item, window in zip(table["item"].to_pylist(), table["window"].cast(pa.binary()).to_pylist()):
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in window.split(b" "))
            items[len(ids)][ids] += [] if item is None else [item]
        self.lengths = {}
        for m, of in items.items():
            ids = np.array(list(of), np.int64).reshape(-1, m)
            hashes = hashed(ids.T)
            order = np.argsort(hashes, kind="stable")
            coarse = np.zeros(1 << COARSE, bool)
            coarse[(hashes >> np.uint64(64 - COARSE)).astype(np.int64)] = True
            names = list(of.values())
            self.lengths[m] = (coarse, hashes[order], ids[order].astype(np.int32), [names[i] for i in order])

    def find(self, row: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(m, places, windows): where the windows of each length stand in a row of word numbers."""
        whole = row > 0
        known = whole
        for m in range(1, max(self.lengths, default=0) + 1):
            whole = whole[: len(row) - m + 1] & known[m - 1 :]
            if m not in self.lengths or not len(whole):
                continue
            coarse, hashes, ids, _ = self.lengths[m]
            places = np.flatnonzero(whole)
            code = hashed([row[places + k] for k in range(m)])
            likely = coarse[(code >> np.uint64(64 - COARSE)).astype(np.int64)]
            places, code = places[likely], code[likely]
            first, last = np.searchsorted(hashes, code, "left"), np.searchsorted(hashes, code, "right")
            n = last - first  # windows of equal hash: one, or none
            at = np.repeat(places, n)
            window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            same = np.ones(len(at), bool)
            for k in range(m):
                same &= row[at + k] == ids[window, k]
            yield m, at[same], window[same]


def hashed(columns) -> np.ndarray:
    code = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        code = (code ^ column.astype(np.uint64)) * BASE
        code ^= code >> np.uint64(29)
    return code


def _cut(text: bytes, spans: list[int]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    places = [x.span() for x in re.finditer(rb"[^ ]+", text.translate(TABLE))]
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]])


def _scan(index: object, first: bool, cut: bool):
    """One pass: adds the spans (first word, word after the last; merged, in order) and items of one block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index.value
        for batch in slices(batches, limit=16_000_000, rows=20_000):
            docs, n = batch.column("text").cast(pa.binary()).to_pylist(), batch.num_rows
            words = BREAK.join(x or b"" for x in docs).translate(TABLE).replace(BREAK, b" \xff ").split()
            row = np.fromiter(map(found.vocabulary.__getitem__, words), np.int64, len(words))
            doc = np.cumsum(row == -1)
            sizes = np.bincount(doc[row != -1], minlength=n)
            starts = np.flatnonzero(np.concatenate([[True], row == -1])) if n else np.zeros(0, np.int64)  # of each document
            depth, items = np.zeros(len(row) + 1, np.int64), defaultdict(set)
            if not first:
                for i, (spans, names) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())):
                    np.add.at(depth, starts[i] + np.array(spans[::2], np.int64), 1)
                    np.add.at(depth, starts[i] + np.array(spans[1::2], np.int64), -1)
                    items[i].update(names)
            for m, places, window in found.find(row):
                np.add.at(depth, places, 1)
                np.add.at(depth, places + m, -1)
                names = found.lengths[m][3]
                for i, k in np.unique(np.stack([doc[places], window], 1), axis=0).tolist():
                    items[i].update(names[k])
            covered = np.concatenate([[False], np.cumsum(depth)[:-1] > 0, [False]])
            covered[1:-1] &= row != -1
            edges = np.flatnonzero(covered[1:] != covered[:-1])  # pairs of first word and word after the last
            owner = doc[edges[::2]] if len(edges) else np.zeros(0, np.int64)
            ends = np.searchsorted(owner, np.arange(n + 1)) * 2
            local = (edges - starts[np.repeat(owner, 2)]).tolist()
            spans = [local[ends[i] : ends[i + 1]] for i in range(n)]
            out = {"kept": batch.column("kept"), "text": batch.column("text"), "n_words": pa.array(sizes, pa.int64()), "spans": pa.array(spans, pa.list_(pa.int64())), "items": pa.array([sorted(items[i]) if i in items else [] for i in range(n)], pa.list_(pa.string()))}
            if cut:
                out["text"] = pa.array([x if x is None or not s else _cut(x, s) for x, s in zip(docs, spans)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return scan


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 10, cut: bool = False) -> DataFrame:
    """Per row of ``docs`` (kept: all its columns as a struct; text; n_words; spans: word places of hit words, from and
    to, in turn; items: ids, as sorted strings, of the items of which a window occurs). With ``cut`` the text is without
    the hit words.

    A null text has no words; an item without an id hits words and is in no list; repeated rows are each searched;
    extra columns of any name travel in ``kept``. Empty tables give no rows, or no hits.
    """
    spark = docs.sparkSession
    entries = windows(benchmark, size)
    weight = entries.agg(F.sum(F.octet_length("window") + 16)).first()[0] or 0
    blocks = max(1, -(-weight // BLOCK))
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text" or cut)).alias("kept"), "text")
    kind = dict(out.dtypes)["kept"]
    for k in range(blocks):
        index = spark.sparkContext.broadcast(Index(entries.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k).select("item", "window").toArrow()))
        out = out.mapInArrow(_scan(index, k == 0, cut and k == blocks - 1), f"kept {kind}, text string, n_words long, spans array<long>, items array<string>")
    return out


def remove(docs: DataFrame, benchmark: DataFrame, how: str = "spans", size: int = 10) -> DataFrame:
    """``docs`` without the documents in which a window of the benchmark occurs (``how='documents'``) or without the hit
    words (``how='spans'``; what stands between hit words that follow each other goes too). A null text stays null."""
    if how not in ("spans", "documents"):
        raise ValueError(f"how: {how}")
    found = scan(docs, benchmark, size, cut=True) if how == "spans" else scan(docs, benchmark, size, cut=True).filter("size(spans) = 0")
    return found.select(*(F.col("text") if c == "text" else F.col(f"kept.`{c}`") for c in docs.columns))


def report(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document; see ``scan``."""
    found = scan(docs.select("doc_id", "text"), benchmark, size)
    hit = F.expr("aggregate(transform(spans, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (s, x) -> s + x)")
    return found.select("kept.doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
