"""Phrase collocation mining: best-first branch-and-bound growth of a prefix tree over each language's words.

A phrase's score is its worst cut, ``a*n/(l*r)``. As ``a`` is at most ``l`` and at most ``r``, no phrase that begins or
ends with a word of count c can score more than ``n/c``: the count of a one-word prefix (or suffix) is an admissible
bound for everything that grows from it. So words are opened in the order of their bounds, rarest first, in rounds that
each take in a growing share of the word mass, and a language is left as soon as its ``top``-th surviving score exceeds
the bound of every word not yet opened; ties at that score are in by then. What is never opened can't be in the result.

In a round pairs are grown first and longer phrases only from pairs that reach the least count. Tasks learn which words
and pairs do from bitmaps of fixed size; a false hit there costs a count that is dropped later and never a result.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, slices, spread, stored

BREAK = b"\xff"  # no byte of UTF-8: stands for all that parts pieces
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + BREAK * 10 + b" ")
BITS = 1 << 26  # of a bitmap: 8 MB
MIX = (1_000_003, 778_777_783, 536_870_909)  # for the first word, the second and the language
HELD = 400_000  # distinct phrases that a task holds before it hands them on
SHARES = (8, 2, 1)  # a round opens the words that make up 1/8, 1/2 and all of the mass of frequent words, but ``top`` at least
COUNTS = "lang string, phrase string, f long"


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(language, words of its texts) of a slice, with BREAK wherever two words are not neighbours in a piece."""
    for batch in slices(batches, limit=16_000_000, rows=1 << 20):
        texts, by_lang = batch.column("text").cast(pa.binary()).to_pylist(), defaultdict(list)
        for lang, text in zip(batch.column("lang").to_pylist(), texts):
            by_lang[lang].append(text)
        for lang, group in by_lang.items():
            yield lang, BREAK.join(group).translate(TABLE).replace(BREAK, b" \xff ").split()


def _rows(counts: dict[str, dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
    for lang, of in counts.items():
        keys = list(of)
        for i in range(0, len(keys), 50_000):
            part = keys[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array([of[k] for k in part], pa.int64())], ["lang", "phrase", "f"])


def _count_words(held: int):
    """Counts of words; the count of the empty phrase is that of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        for lang, words in _words(batches):
            found = counts[lang]
            found.update(words)
            breaks = found.pop(BREAK, 0)
            found[b""] += len(words) - breaks
            if sum(map(len, counts.values())) > held:
                yield from _rows(counts)
                counts.clear()
        yield from _rows(counts)

    return count


def _spot(first: "F.Column", second: "F.Column | None" = None) -> "F.Column":
    """Place of a word or a pair of a language in a bitmap."""
    of = lambda c, by: F.crc32(c.cast("binary")) * F.lit(by).cast("long")
    total = of(first, MIX[0]) + of(F.col("lang"), MIX[2])
    return F.pmod(total if second is None else total + of(second, MIX[1]), F.lit(BITS).cast("long"))


def _bitmap(df: DataFrame, spot: "F.Column") -> np.ndarray:
    """A fixed 8 MB at most come to the driver, as words of 64 bits."""
    table = df.select(spot.alias("at")).groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(BITS >> 6, np.uint64)
    out[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return out


def _has(bitmap: np.ndarray, at: "np.ndarray | int") -> "np.ndarray | bool":
    return (bitmap[at >> 6] >> np.uint64(at & 63) if isinstance(at, int) else bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


class _Ids(dict):
    """Numbers of one language's words, 0 for words that can't reach the least count; the lowest two bits say whether
    the word was opened earlier (1), is opened now (2) or later (3)."""

    def __init__(self, lang: str, bitmaps: tuple[np.ndarray, np.ndarray, np.ndarray]):
        super().__init__({BREAK: 0})
        self.lang, self.bitmaps, self.words, self.hashes = zlib.crc32(lang.encode()), bitmaps, [b""], [0]

    def __missing__(self, word: bytes) -> int:
        code = zlib.crc32(word)
        earlier, now, frequent = self.bitmaps
        at = (code * MIX[0] + self.lang * MIX[2]) % (len(frequent) * 64)
        number = 0
        if _has(frequent, at):
            number = len(self.words) * 4 + (1 if _has(earlier, at) else 2 if _has(now, at) else 3)
            self.words.append(word)
            self.hashes.append(code)
        if number or len(self) < 2_000_000:
            self[word] = number
        return number


def _distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first of equal rows, and how many there are; exact, by numbering one column after the other."""
    code = columns[0]
    for column in columns[1:]:
        _, code = np.unique(code * (int(column.max(initial=0)) + 1) + column, return_inverse=True)
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    return first, n


def _grow(lengths: range, word_maps: object, pair_map: object = None):
    """The counting of one round: phrases of ``lengths`` frequent words of which an end is opened now and none earlier.
    With ``pair_map``, only those whose pairs are all frequent or not counted so far."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[str, _Ids] = {}
        counts: dict[str, Counter] = defaultdict(Counter)
        for lang, words in _words(batches):
            known = ids.setdefault(lang, _Ids(lang, word_maps.value))
            row = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            stage = row & 3
            alive = (row[:-1] > 0) & (row[1:] > 0)  # pairs at each place
            if pair_map is not None:
                hashes = np.array(known.hashes, np.uint64)[row >> 2]
                at = (hashes[:-1] * np.uint64(MIX[0]) + hashes[1:] * np.uint64(MIX[1]) + np.uint64(known.lang * MIX[2])) % np.uint64(len(pair_map.value) * 64)
                alive &= (np.minimum(stage[:-1], stage[1:]) == 3) | _has(pair_map.value, at)
            whole = np.ones(len(row), bool)
            for m in range(2, lengths.stop):
                whole = whole[: len(row) - m + 1] & alive[m - 2 :]
                if m not in lengths or not len(whole):
                    continue
                places = np.flatnonzero(whole & (np.minimum(stage[: len(whole)], stage[m - 1 :]) == 2))
                first, n = _distinct([row[places + k] >> 2 for k in range(m)])
                names, found = known.words, counts[lang]
                for key, k in zip(zip(*((row[places[first] + k] >> 2).tolist() for k in range(m))), n.tolist()):
                    found[key] += k
            if sum(map(len, counts.values())) > HELD:
                yield from _rows({x: {b" ".join([ids[x].words[i] for i in key]): k for key, k in of.items()} for x, of in counts.items()})
                counts.clear()
        yield from _rows({x: {b" ".join([ids[x].words[i] for i in key]): k for key, k in of.items()} for x, of in counts.items()})

    return count


def _survivors(counts: DataFrame, plan: DataFrame, cover: int) -> DataFrame:
    """Scored phrases of which both ends are open, without those that a longer one covers."""
    parts = F.split("phrase", " ", -1)
    phrases = counts.filter("instr(phrase, ' ') > 0").withColumn("ws", parts).withColumn("m", F.size("ws"))
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), "m", "ws", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k")).select(
        "lang", "phrase", "a", "m", "k", F.array_join(F.slice("ws", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("ws", F.col("k") + 1, F.col("m") - F.col("k")), " ").alias("rest"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(F.broadcast(plan), "lang")
    score = F.expr("cast((cast(a * 1000 as decimal(19, 0)) * cast(n as decimal(18, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0))) as long)")
    scored = cuts.groupBy("lang", "phrase", "a", "m", "n", "most").agg(
        F.count("*").alias("cuts"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("worst"), F.max(F.expr("if(k = 1, l, 0)")).alias("head"), F.max(F.expr("if(k = m - 1, r, 0)")).alias("tail"),
    ).filter("cuts = m - 1 and head <= most and tail <= most")
    inner = F.array(F.slice("ws", F.lit(1), F.col("m") - 1), F.slice("ws", F.lit(2), F.col("m") - 1))
    longer = phrases.filter("m > 2").select("lang", "f", F.explode(inner).alias("ws")).groupBy("lang", F.array_join("ws", " ").alias("phrase")).agg(F.max("f").alias("covers"))
    live = scored.join(longer, ["lang", "phrase"], "left").filter(f"covers is null or 100 * covers < {int(cover)} * a")
    return live.select("lang", "phrase", "a", "worst.l", "worst.r", "n", "worst.score")


def mine(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, cover: int = 100) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``longest`` words by score, as (lang, rank, phrase, a, l, r, n, score).

    A null text is empty and a null language is ``und``. Equal scores go by count and phrase, so repeated rows and ties
    have one result; rows without words add nothing, an empty table gives no rows, and other columns are not read. One
    row a language comes to the driver.
    """
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    texts = spread(texts, folder, "texts")
    added = lambda counted: counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    found = stored(added(texts.mapInArrow(_count_words(HELD), COUNTS)).filter(f"f >= {int(least)} or phrase = ''"), folder, "words")
    words, totals = found.filter("phrase <> ''"), {r["lang"]: r["f"] for r in found.filter("phrase = ''").collect()}
    mass = Window.partitionBy("lang")
    steps = words.groupBy("lang", "f").agg(F.count("*").alias("words")).select(
        "lang", "f", F.sum("words").over(mass.orderBy("f")).alias("opens"), F.sum(F.expr("words * f")).over(mass.orderBy("f")).alias("below"), F.sum(F.expr("words * f")).over(mass).alias("whole"))
    enough = f"if(below = whole or opens >= {int(top)}, f, null)"
    limits = {r["lang"]: r for r in steps.groupBy("lang").agg(*(F.greatest(F.min(F.expr(f"if(below * {s} >= whole, f, null)")), F.min(F.expr(enough))).alias(f"s{s}") for s in SHARES)).collect()}
    counts, before, opened = words, {x: 0 for x in limits}, sorted(limits)
    for step, share in enumerate(SHARES):
        most = {x: limits[x][f"s{share}"] for x in opened}
        plan = spark.createDataFrame([(x, totals[x], most[x], before[x], 1000 * totals[x] // (most[x] + 1)) for x in opened], "lang string, n long, most long, was long, bound long") if opened else None
        if plan is None:
            break
        here, now = texts.filter(F.col("lang").isin(opened)), words.join(F.broadcast(plan), "lang")
        maps = spark.sparkContext.broadcast(tuple(_bitmap(now.filter(rule), _spot(F.col("phrase"))) for rule in ("f <= was", "f <= most", "true")))
        pairs = stored(added(here.mapInArrow(_grow(range(2, 3), maps), COUNTS)).filter(f"f >= {int(least)}"), folder, f"pairs{step}")
        counts = counts.unionByName(pairs)
        if longest > 2:
            both = F.split("phrase", " ", -1)
            pair_map = spark.sparkContext.broadcast(_bitmap(counts.filter("length(phrase) - length(replace(phrase, ' ', '')) = 1"), _spot(both[0], both[1])))
            counts = counts.unionByName(stored(added(here.mapInArrow(_grow(range(3, longest + 1), maps, pair_map), COUNTS)).filter(f"f >= {int(least)}"), folder, f"longer{step}"))
            pair_map.unpersist()
        maps.unpersist()
        live = stored(_survivors(counts, plan, cover), folder, f"live{step}")
        if share > 1:
            sure = {r["lang"] for r in live.join(F.broadcast(plan.select("lang", "bound")), "lang").filter("score > bound").groupBy("lang").count().filter(f"count >= {int(top)}").collect()}
        else:
            sure = set(opened)
        sure |= {x for x in opened if most[x] == limits[x]["s1"]}
        done = live.filter(F.col("lang").isin(sorted(sure))) if sure else live.filter("false")
        settled = done if step == 0 else settled.unionByName(done)
        opened, before = [x for x in opened if x not in sure], most
    if not limits:
        settled = _survivors(words, spark.createDataFrame([], "lang string, n long, most long, was long, bound long"), cover)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return settled.withColumn("rank", F.row_number().over(order).cast("long")).filter(f"rank <= {int(top)}").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
