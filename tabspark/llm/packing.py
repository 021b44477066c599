"""Best-fit packing of token pieces into sequences by a configuration linear program over the length histogram.

Only the histogram (one count for each length up to the capacity) comes to the driver. Multiplicative weights with a
knapsack priced by dynamic programming give a fractional solution; randomised rounding, and programs of what is left,
give whole multiplicities whose slots are exactly the pieces. A piece finds its slot from its length and its rank there.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, shared_dir, slices, stored
from .tokenids import END_ID, SLICE, encoder

CAPACITY = 2048
ROUNDS = 24  # of multiplicative weights, at most, for each linear program; that of a corpus needs some three
GAP = 0.01  # between a linear program's value and its bound


def knapsack(value: np.ndarray, capacity: int) -> np.ndarray:
    """``best[c]``: the largest total value of lengths (each as often as one likes) whose sum is at most c;
    ``value[l]`` is for length l, 0 for one that may not be used."""
    lengths = np.flatnonzero(value > 0)
    worth, best = value[lengths], np.zeros(capacity + 1)
    for c, n in enumerate(np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()):
        if c:
            best[c] = max(best[c - 1], (best[c - lengths[:n]] + worth[:n]).max(initial=0.0))
    return best


def filled(first: int, left: np.ndarray, value: np.ndarray, best: np.ndarray, capacity: int) -> tuple[dict[int, int], float]:
    """The configuration that begins with one ``first`` and goes along the table of the knapsack: at every step the
    length, of those that ``left`` still has, that loses least against the best value of the room; the longest of
    equal ones. ``value`` is -inf where ``left`` is 0, and is so again when this returns."""
    config, room, total, spent = {}, capacity, 0.0, []
    l = first
    while True:
        config[l] = config.get(l, 0) + 1
        total += value[l]
        room -= l
        if config[l] >= left[l]:
            spent.append((l, value[l]))
            value[l] = -np.inf
        if not room:
            break
        gain = best[:room] + value[room:0:-1]
        i = int(gain.argmax())
        if gain[i] == -np.inf:
            break
        l = room - i
    for l, v in spent:
        value[l] = v
    return config, total


def fractional(demand: np.ndarray, capacity: int, rounds: int = ROUNDS, gap: float = GAP, eta: float = 4.0, slack: float = 0.02) -> tuple[dict[tuple, float], float]:
    """(configurations with their multiplicities, bound): the linear program that covers the whole demand by as few
    configurations as it can, by multiplicative weights.

    Prices of lengths begin at their volume (the dual of the volume bound) and fall by exp(-eta * cover) as what is
    covered of their demand grows. A round's knapsack table gives the best value of a configuration under its prices,
    so the price of the whole demand over it bounds any solution from below. Configurations go along that table, the
    least covered lengths first; the best one and those within ``slack`` of its value enter, until a length has had
    an eighth of its demand in this round (later a thirty-second). It ends when the multiplicities, brought up to a full
    cover of every length, are within ``gap`` of the bound, or after ``rounds``. The program of a whole corpus, whose
    bound is the volume, ends after a few rounds; hard ones of few pieces come within some 4 % in 300 rounds.
    """
    lengths, ids = np.arange(len(demand)), np.flatnonzero(demand > 0)
    live = demand > 0
    covered, found, bound = np.zeros(len(demand)), {}, 0.0
    for turn in range(rounds):
        step = 1 / 8 if turn < 8 else 1 / 32
        price = np.where(live, lengths * np.exp(-eta * (covered - covered[ids].min())), 0.0)
        best = knapsack(price, capacity)
        bound = max(bound, float((price * demand).sum()) / best[capacity])
        left, value, took = step * demand, np.where(live, price, -np.inf), False
        for first in ids[np.lexsort((-ids, covered[ids]))].tolist():
            while left[first] > 0 and (not took or value[first] + best[capacity - first] >= (1 - slack) * best[capacity]):
                config, total = filled(first, demand, value, best, capacity)
                if took and total < (1 - slack) * best[capacity]:
                    break
                times = min(left[l] / k for l, k in config.items())
                key = tuple(sorted(config.items(), reverse=True))
                found[key] = found.get(key, 0.0) + times
                for l, k in config.items():
                    left[l] -= k * times
                    if left[l] <= 1e-9 * demand[l]:
                        left[l], value[l] = 0.0, -np.inf
                took = True
        covered[ids] += step - left[ids] / demand[ids]
        least = covered[ids].min()
        if least > 0 and sum(found.values()) / least <= (1 + gap) * bound:
            break
    return {k: x / covered[ids].min() for k, x in found.items()} if covered[ids].min() > 0 else found, bound


def plan(demand: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS, gap: float = GAP, seed: int = 4) -> list[tuple[dict[int, int], int]]:
    """Whole multiplicities of configurations whose slots are exactly the demand.

    The fractional solution is rounded at random, up with the probability of the fraction, as far as the demand goes;
    what is left has a linear program of its own, until nothing is left. So every sequence (but the full ones, which
    need no program) is a column of a program.
    """
    chosen = [({capacity: 1}, int(demand[capacity]))] if demand[capacity] else []
    left, rng = demand.copy(), np.random.default_rng(seed)
    left[capacity] = 0
    while left.any():
        columns, _ = fractional(left, capacity, rounds, gap)
        order = sorted(columns, key=lambda k: (-sum(l * n for l, n in k), k))
        up = rng.random(len(order))
        took = False
        for key, u in [*zip(order, up), (max(columns, key=columns.get), None)]:
            times = min(int(columns[key] + u) if u is not None else 0 if took else 1, *(int(left[l]) // k for l, k in key))
            if times > 0:
                took = True
                chosen.append((dict(key), times))
                for l, k in key:
                    left[l] -= k * times
    return chosen


def pieces(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): texts as token ids with an end id, cut into at most ``capacity`` ids.

    Only the first piece of a document may be shorter than the capacity if there are several.
    """
    end = np.asarray([end_id], "<u4").tobytes()
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())

    def cut(batches):
        enc = encoder(tokenizer)
        for b in slices(batches, limit=SLICE, rows=8192):
            out = ([], [], [], [], [])
            for doc, own in zip(b.column(0).to_pylist(), enc.encode(b.column(1))):
                ids = bytes(own) + end
                n, start, k = len(ids) // 4, 0, 0
                while start < n:
                    length = (n - start) % capacity or capacity
                    for column, x in zip(out, (doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))):
                        column.append(x)
                    start, k = start + length, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=list(names))

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_texts(rows, cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(cut: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Add (sequence_id, offset) to stored pieces; every piece is placed once, and sequences have no gaps.

    Ranks are counted inside (length, salt) and moved on by the counts of the salts before, so a length that a third
    of all pieces have is dealt to many tasks. The counts are bounded by capacity * salts, the plan by capacity.
    """
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    demand = np.zeros(capacity + 1, np.int64)
    for l, n in counts.items():
        demand[l] = n
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    base, used = 0, np.zeros(capacity + 1, np.int64)
    for config, times in plan(demand, capacity, rounds):
        offset = 0
        for l, k in config.items():
            slots.setdefault(l, []).append((int(used[l]), base, k, offset))
            used[l] += k * times
            offset += k * l
        base += times
    table = {l: np.asarray(x, np.int64).T for l, x in slots.items()}
    salts = max(64, int(demand.max() // 100_000))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)))
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = before.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("rank", rank.cast("long")).join(before, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def seat(batches):
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order])) + 1
            for group in np.split(order, edges) if len(order) else []:
                first, base, k, offset = table[int(length[group[0]])]
                i = np.searchsorted(first, rank[group], "right") - 1
                q = rank[group] - first[i]
                seq[group] = base[i] + q // k[i]
                off[group] = offset[i] + q % k[i] * length[group[0]]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return map_texts(ranked, seat, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Pack every text. A null or empty text is one piece with the end id; repeated rows are packed each; an empty
    table gives no rows; other columns are not read."""
    cut = stored(pieces(df, tokenizer, capacity), shared_dir(df.sparkSession), "pieces")
    return place(cut, capacity, rounds)
