"""Near-duplicate classes by MinHash with tensored banding, candidates confirmed on full shingle sets.

Two small collections A and B of sub-keys are made for each document, each sub-key of a few minhash values; every
pair (A_i, B_j) is the key of one hash table, so SUB * SUB tables cost only 2 * SUB * WIDTH minhash values. Two
documents of similarity s meet in a table unless they differ in all of A or all of B:
P(miss) <= 2 * (1 - s**width)**SUB. The width is the largest for which that is at most MISS at the threshold: 4 values
at 0.85 (1.5e-5), 3 at 0.8 (2.1e-5).

Exact copies (equal sets, by a 128-bit digest) become one representative first. Sub-keys that only one document has
are dropped before pairs are formed. The full sets of the documents left give a bound: a shingle that no other of
them has is in no intersection, so with ``m`` shared shingles of ``n`` two documents have at most min(m, m') in
common. A document whose bound is below the threshold against every set goes; a pair whose bound is below it is not
compared. Both are exact: nothing that is linked is lost.

In each table entry all members are compared with its least member. What these comparisons have not joined is taken
across components: pairs that meet and that two exact bounds allow, the one above and that of parity sketches (the
sketches of two sets differ in at most as many bits as the sets in elements). Both bounds and the components are
conditions of the join, so only pairs that are very likely alike leave it, to be compared on full sets. So every pair
that meets in a table is compared, ruled out for certain, or already in one component. The pairs of a sub-key are dealt
to cells of bounded size, and those inside its largest component are never formed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, map_texts, shared_dir, slices, stored

SHINGLE = 5  # words
SUB = 16  # sub-keys in each collection
MISS = 3e-5  # probability, at most, that two sets of the least similarity meet in no table
SKETCH = 512  # bits of a parity sketch
BLOCK = 4096  # members of a sub-key, about, on each side of a task's pairs
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_U = np.uint64


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64) | _U(1)


_MIX = _odd(11, SHINGLE)
_FOLD = _odd(14, 8)


def width_for(threshold: int) -> int:
    """Minhash values in each sub-key, 8 at most."""
    return max([w for w in range(1, 9) if 2 * (1 - (threshold / 100) ** w) ** SUB <= MISS], default=1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (all bits depend on all bits)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Words:
    """64-bit hashes of words, kept in a bounded table."""

    def __init__(self, limit: int = 250_000):
        self.known, self.limit = {}, limit

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > self.limit:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None, words: Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; one of all words if they are fewer than SHINGLE."""
    h = words(WORD.findall(text.translate(_LOWER))) if text else np.zeros(0, np.uint64)
    n = len(h)
    if not n:
        return h
    if n < SHINGLE:
        return mixed((h * _MIX[:n]).sum(keepdims=True, dtype=np.uint64) + _U(n))
    out = np.zeros(n - SHINGLE + 1, np.uint64)
    for j in range(SHINGLE):
        out += h[j : n - SHINGLE + 1 + j] * _MIX[j]
    return np.unique(mixed(out + _U(SHINGLE)))


SIGNATURE = "doc_id long, n long, d1 long, d2 long, keys array<long>"


def signatures(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Maps (doc_id, text) to the size of the shingle set, its digest, and its sub-keys of ``width`` minhash values."""
    factors, terms = _odd(12, 2 * SUB * width), _odd(13, 2 * SUB * width)

    def run(batches):
        words = Words()
        for b in slices(batches, limit=2_000_000):
            sets = [shingles(t, words) for t in b.column(1).to_pylist()]
            size = np.array([len(x) for x in sets], np.int64)
            live = np.flatnonzero(size)
            digest = np.zeros((2, len(sets)), np.uint64)
            keys = np.zeros((len(sets), 2 * SUB), np.uint64)
            if len(live):
                flat = np.concatenate([sets[i] for i in live])
                start = np.concatenate([[0], np.cumsum(size[live])[:-1]])
                digest[0, live] = np.add.reduceat(mixed(flat + _FOLD[0]), start)
                digest[1, live] = np.add.reduceat(mixed(flat ^ _FOLD[1]), start)
                least = np.empty((len(live), 2 * SUB * width), np.uint64)
                for k in range(2 * SUB * width):
                    least[:, k] = np.minimum.reduceat(flat * factors[k] + terms[k], start)
                sub = mixed((least.reshape(len(live), 2 * SUB, width) * _FOLD[:width]).sum(axis=2, dtype=np.uint64) + np.arange(2 * SUB, dtype=np.uint64) * _MIX[0])
                sub[:, :SUB] &= ~_U(1)  # collection A: even; B: odd
                sub[:, SUB:] |= _U(1)
                keys[live] = sub
            offsets = np.concatenate([[0], np.cumsum(np.where(size > 0, 2 * SUB, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[live].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), lists], names=["doc_id", "n", "d1", "d2", "keys"])

    return run


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """[set, SKETCH / 64] whether an odd number of a set's elements has each hash value, as bits of 64-bit numbers."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    bit = (np.concatenate(sets).view(np.uint64) >> _U(20)) % _U(SKETCH) if sets else np.zeros(0, np.uint64)
    odd = np.bincount(owner * SKETCH + bit.astype(np.int64), minlength=len(sets) * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(sets), SKETCH), axis=1).view(np.int64)


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for b in slices(batches, limit=2_000_000):
        sets = [shingles(t, words).view(np.int64) for t in b.column(1).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        ends = np.arange(len(sets) + 1, dtype=np.int32) * (SKETCH // 64)
        bits = pa.ListArray.from_arrays(pa.array(ends), pa.array(sketches(sets).ravel()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), bits], names=["rep", "grams", "sketch"])


def alike(both: Column, a: Column, b: Column, threshold: int) -> Column:
    """100 * intersection >= threshold * union."""
    return 100 * both >= threshold * (a + b - both)


def possible(na: Column, ma: Column, nb: Column, mb: Column, threshold: int) -> Column:
    """Whether sets of these sizes, with so many shingles that others have, can be alike."""
    return alike(F.least(ma, mb, na, nb), na, nb, threshold)


def sketched(a: Column, b: Column, na: Column, nb: Column, threshold: int) -> Column:
    """Whether sets with these sketches can be alike: they have at most (na + nb - bits that differ) / 2 in common."""
    differ = sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(SKETCH // 64)), F.lit(0))
    return alike((na + nb - differ) / 2, na, nb, threshold)


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets (rep, grams) are alike."""
    left, right = sets.select(F.col("rep").alias("a"), F.col("grams").alias("ga")), sets.select(F.col("rep").alias("b"), F.col("grams").alias("gb"))
    full = pairs.select("a", "b").join(left, "a").join(right, "b")
    both = F.size(F.array_intersect("ga", "gb"))
    return full.filter(alike(both, F.size("ga"), F.size("gb"), threshold)).select("a", "b")


def components(edges: DataFrame, folder: str, name: str = "cc", rounds: int = 60) -> DataFrame:
    """(node, component) of undirected edges (a, b): the least id reachable. Alternates two steps over stored tables
    (every node to the least of its neighbours, for larger and for smaller neighbours) until no edge changes."""
    one = stored(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u <> v").distinct(), folder, f"{name}-0")
    before = None
    for i in range(1, rounds + 1):
        both = one.select("u", "v").union(one.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # stored, so that the join reads two plain exchanges and can split the neighbours of a hub
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), folder, f"{name}-{i}m")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.filter("u <> v").distinct(), folder, f"{name}-{i}l")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), folder, f"{name}-{i}s")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        one = stored(small.filter("u <> v").select("u", "v").distinct(), folder, f"{name}-{i}")
        now = one.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = one.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.union(roots.select(F.col("component").alias("node"), "component").distinct())


def _candidates(reps: DataFrame, folder: str) -> DataFrame:
    """(rep, n, ka, kb): representatives with the sub-keys of A and of B that another one has too, some of each."""
    sub = reps.select("rep", "n", F.explode("keys").alias("key"))
    shared = stored(sub.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"), folder, "shared")  # as in _dealt
    met = sub.join(shared, "key").groupBy("rep", "n").agg(F.collect_list("key").alias("keys"))
    odd = lambda k: k.bitwiseAND(F.lit(1)) == 1
    return met.select("rep", "n", F.filter("keys", lambda k: ~odd(k)).alias("ka"), F.filter("keys", odd).alias("kb")).filter("size(ka) > 0 and size(kb) > 0")


def _tables(live: DataFrame) -> DataFrame:
    """(table, rep, n, m): entries of all tables."""
    table = F.flatten(F.transform("ka", lambda a: F.transform("kb", lambda b: F.xxhash64(a, b))))
    return live.select(F.explode(table).alias("table"), "rep", "n", "m")


def _dealt(members: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """The members of the sub-keys that hold several components, with the largest component of the key (``major``) and
    the numbers of rows and columns that its pairs are dealt to: about ``block`` members of the other components a
    row, ``block`` members of all a column."""
    counts = members.groupBy("key", "component").agg(F.count("*").alias("c"))
    keys = counts.groupBy("key").agg(F.max(F.struct("c", "component")).alias("most"), F.sum("c").alias("c"), F.count("*").alias("components")).filter("components > 1")
    rows, columns = F.ceil((F.col("c") - F.col("most.c")) / block), F.ceil(F.col("c") / block)
    keys = keys.select("key", F.col("most.component").alias("major"), rows.cast("int").alias("rows"), columns.cast("int").alias("columns"))
    return members.join(stored(keys, folder, "keys"), "key")  # stored, so that the join can split a hot sub-key's members


def _sides(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sides x and y of the join within sub-keys: each pair of a member outside the largest component and any other
    member meets in one cell (row, column), so neither a hot sub-key nor a large component lands in one task."""
    side = ["key", "rep", "n", "m", "kb", "sketch", "component", "major"]
    row, column = F.pmod(F.xxhash64("rep"), F.col("rows")).cast("int"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("columns")).cast("int")
    x = open_.filter("component <> major").select(*side, row.alias("row"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("column"))
    y = open_.select(*side, column.alias("column"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"))
    return x.alias("x"), y.alias("y")


def classes(df: DataFrame, threshold: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document; near-duplicate if 100 * |A & B| >= threshold * |A | B|.

    A null text, or one without words, has no shingles and is alone. A row with a null doc_id can't be linked: it has
    a null component_id and is kept. A document is its id: of repeated rows of one doc_id the one with the greatest
    text counts, and one row is returned. An empty table gives no rows; extra columns are not read.
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    signed = signatures(width_for(threshold))
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    nameless, docs = docs.filter("doc_id is null"), docs.filter("doc_id is not null")
    sig = stored(map_texts(docs, signed, SIGNATURE), folder, "signatures")
    repeated = sig.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").limit(1).count()
    if repeated:
        docs = stored(docs.groupBy("doc_id").agg(F.max("text").alias("text")), folder, "documents")
        sig = stored(map_texts(docs, signed, SIGNATURE), folder, "signatures-single")
    same = ["n", "d1", "d2"]
    firsts = sig.filter("n > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"))
    firsts = stored(firsts, folder, "representatives")
    reps = sig.join(firsts.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "n", "keys")
    met = stored(_candidates(reps, folder), folder, "candidates")
    # a merge join at every size: the ids grow with the input, so they are never broadcast
    texts = docs.join(met.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi").select("doc_id", "text")
    sets = stored(map_texts(texts, _full_sets, "rep long, grams array<long>, sketch array<long>"), folder, "sets")
    alone = sets.select("rep", F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("c"), F.min("rep").alias("rep"))
    alone = alone.filter("c = 1").groupBy("rep").agg(F.count("*").alias("u"))
    live = met.join(alone, "rep", "left").withColumn("m", F.col("n") - F.coalesce("u", F.lit(0)))
    live = live.filter(100 * F.col("m") >= threshold * F.col("n")).join(sets.select("rep", "sketch"), "rep")
    live = stored(live.select("rep", "n", "m", "ka", "kb", "sketch"), folder, "live")
    tables = stored(_tables(live), folder, "tables")
    entries = stored(tables.groupBy("table").agg(F.min(F.struct("rep", "n", "m")).alias("hub"), F.count("*").alias("c")).filter("c > 1"), folder, "entries")
    stars = tables.join(entries, "table").filter(F.col("rep") != F.col("hub.rep")).filter(possible(F.col("hub.n"), F.col("hub.m"), F.col("n"), F.col("m"), threshold))
    stars = stars.select(F.col("hub.rep").alias("a"), F.col("rep").alias("b")).distinct()
    edges = stored(confirmed(stars, sets, threshold), folder, "edges-1")
    found = components(edges, folder, "cc1")
    # two that meet have a sub-key of A in common: those of several components are paired by it
    named = live.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    members = stored(named.select("rep", "n", "m", "kb", "sketch", "component", F.explode("ka").alias("key")), folder, "members")
    open_ = stored(_dealt(members, folder), folder, "open")
    x, y = _sides(open_)
    both = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", "row", "column")]
    # x is never of the key's largest component; two of the others are paired once
    both.append((F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.major")) | (F.col("x.component") < F.col("y.component"))))
    both.append(possible(F.col("x.n"), F.col("x.m"), F.col("y.n"), F.col("y.m"), threshold))
    both.append(sketched(F.col("x.sketch"), F.col("y.sketch"), F.col("x.n"), F.col("y.n"), threshold))
    both.append(F.arrays_overlap("x.kb", "y.kb"))
    cross = x.join(y.hint("merge"), reduce(and_, both)).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
    more = stored(confirmed(cross, sets, threshold), folder, "edges-2")
    if not more.isEmpty():
        found = components(edges.union(more), folder, "cc2")
    whole = firsts.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select(*same, F.coalesce("component", "rep").alias("component"))
    out = sig.select("doc_id", *same).join(whole, same, "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    others = map_texts(nameless, signed, SIGNATURE)
    others = others.select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id")).unionByName(others)
