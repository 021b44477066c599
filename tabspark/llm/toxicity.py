"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words, and beginnings of words (4 to 6 letters, so that inflected and derived forms count),
that labelled toxic texts have and other labelled texts hardly do. Features of a whole text: densities of lexicon
hits by weight, hits close to a second-person word, capitals, punctuation and obfuscated spellings. Trees and
calibration are fitted on the driver from the features (not the texts) of a bounded sample.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GAP_SQL, WORD, labelled_sample, map_texts, slices, split_of
from .trees import Tree, boost, isotonic, margin

PER_CLASS = 5000  # labelled rows of each class that a fit reads at most (about)
LEXICON = 4000  # entries at most, those with the most evidence
LEAST = 5  # toxic sample texts that an entry must be in
CANDIDATES = 50_000  # terms that are weighed for the lexicon, at most: those that most toxic sample texts have
CUT = 0.5
BEGINNINGS = (4, 5, 6)  # lengths of word beginnings in the lexicon
NEAR = 5  # words between a hit and a second-person word
# Second-person words of the four languages of the tables, and digits or signs used for letters.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos ti tú usted ustedes vosotros"
LOOKALIKES = str.maketrans("013457@$!|", "oieastasii")
FEATURES = ("log_words", "hits", "strong", "weight", "log_hits", "near_you", "you", "capitals", "marks", "points", "symbols", "obfuscated", "digits", "top_weight")
_TRIPLE = re.compile(r"(.)\1\1")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»„“”‘’…"


def core(word: str) -> str:
    """A word in small letters without signs at its ends."""
    return word.lower().strip(_EDGE)


def plain(word: str) -> str:
    """A word with look-alikes read as letters and signs inside it left out."""
    return re.sub(r"[\W_]+", "", word.lower().strip(".,;:?\"'()[]{}").translate(LOOKALIKES))


def terms(word: str) -> list[str]:
    """What a word may be looked up by: itself (``=``) and its beginnings (``^``)."""
    return [f"={word}", *(f"^{word[:n]}" for n in BEGINNINGS if len(word) > n)] if word else []


def lexicon(sample: DataFrame, size: int = LEXICON, least: int = LEAST, candidates: int = CANDIDATES) -> dict[str, float]:
    """Log odds of terms from the sample of labelled texts (doc_id, text, label). Two passes: terms that enough toxic
    texts have, then, for these only, how many other texts have them. Of more than ``candidates`` terms the rarest
    have no entry; it is a bound of the fit, and all texts are scored with all entries."""

    def document_counts(wanted: frozenset | None):
        def run(batches):
            n: dict[str, int] = {}
            for b in slices(batches):
                for text in b.column(0).to_pylist():
                    words = {core(w) for w in WORD.findall(text or "")}
                    for t in {t for w in words for t in terms(w)}:
                        if wanted is None or t in wanted:
                            n[t] = n.get(t, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["term", "n"])

        return run

    def counts(label: int, wanted=None, floor: int = 1) -> dict[str, int]:
        texts = map_texts(sample.filter(F.col("label") == label).select("text"), document_counts(wanted), "term string, n long")
        total = texts.groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") >= floor)
        return {r["term"]: r["n"] for r in total.orderBy(F.desc("n"), "term").limit(candidates).collect()}

    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad = counts(1, floor=least)
    good = counts(0, frozenset(bad)) if bad else {}
    odds = {t: float(np.log((n + 0.5) / (sizes.get(1, 0) + 1)) - np.log((good.get(t, 0) + 0.5) / (sizes.get(0, 0) + 1))) for t, n in bad.items()}
    best = sorted((t for t, o in odds.items() if o > 1.5), key=lambda t: (-odds[t] * bad[t] ** 0.5, t))[:size]
    return {t: odds[t] for t in best}


class Features:
    """Feature rows of whole texts. Arrow cuts a slice of texts into words; what a distinct word contributes is looked
    up in a bounded cache, and numpy adds up what the words of a text contribute."""

    def __init__(self, lexicon: dict[str, float], limit: int = 200_000):
        self.limit, self.you = limit, frozenset(SECOND_PERSON.split())
        self.whole = {t[1:]: w for t, w in lexicon.items() if t[0] == "="}
        self.begins = {t[1:]: w for t, w in lexicon.items() if t[0] == "^"}
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, 9), np.float32)  # row 0 is that of all words that contribute nothing
        self.count = 1

    def weight(self, word: str) -> float:
        best, begins = self.whole.get(word, 0.0), self.begins
        for n in BEGINNINGS:
            if len(word) > n and (w := begins.get(word[:n])) is not None and w > best:
                best = w
        return best

    def row(self, word: str) -> tuple | None:
        """What a word contributes: hit, strong hit, weight, second person, capitals, marks, points, symbols, hidden;
        None if nothing."""
        inner = core(word)
        weight = self.weight(inner)
        if inner.isalpha():
            hidden = _TRIPLE.search(inner) is not None
        else:
            mixed = any(map(str.isdigit, inner)) and any(map(str.isalpha, inner))
            hidden = inner != "" and (mixed or not inner.isalnum() or _TRIPLE.search(inner) is not None)
        if hidden and weight == 0.0:
            weight = self.weight(plain(word))
        signs = () if word.isalpha() else tuple(sum(map(word.count, group)) for group in ("!?", ".,;:", "#*$%&|<>@"))
        capitals = word.isupper() and sum(map(str.isalpha, word)) > 1
        if not (weight or hidden or capitals or any(signs) or inner in self.you):
            return None
        return (weight > 0, weight > 3, weight, inner in self.you, capitals, *(signs or (0, 0, 0)), hidden)

    def number(self, word: str) -> int:
        row, at = self.row(word), 0
        if row is not None:
            if self.count >= len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[self.count], at = row, self.count
            self.count += 1
        self.known[word] = at
        return at

    def of(self, texts: pa.Array) -> np.ndarray:
        """[text, feature]; all 0 for a text without words."""
        out = np.zeros((len(texts), len(FEATURES)))
        if not len(texts):
            return out
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        parts = pc.split_pattern_regex(texts, GAP_SQL)  # at least one word of each text, which may be empty
        starts, coded = parts.offsets.to_numpy()[:-1], parts.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > self.limit:
            self._clear()
        get, number = self.known.get, self.number
        numbers = np.fromiter((number(w) if (k := get(w)) is None else k for w in distinct), np.int64, len(distinct))
        indices = coded.indices.to_numpy()
        real = np.fromiter((w != "" for w in distinct), bool, len(distinct))[indices]
        rows = self.rows[numbers[indices]]
        n = np.add.reduceat(real.astype(np.int64), starts)
        per = np.maximum(n, 1)
        hits, strong, weight, you, capitals, marks, points, symbols, hidden = np.add.reduceat(rows, starts, axis=0, dtype=float).T
        owner = np.repeat(np.arange(len(texts)), np.diff(np.append(starts, len(indices))))
        place = np.cumsum(real) + owner * (NEAR + 1)  # words of two texts are never near
        there, mine = place[rows[:, 3] > 0], np.flatnonzero(rows[:, 0] > 0)
        near = np.zeros(len(texts))
        if len(there) and len(mine):
            k = np.searchsorted(there, place[mine])
            gap = np.minimum(np.abs(place[mine] - there[np.minimum(k, len(there) - 1)]), np.abs(place[mine] - there[np.maximum(k - 1, 0)]))
            near = np.bincount(owner[mine][gap <= NEAR], minlength=len(texts))
        digits = pc.count_substring_regex(texts, "[0-9]").to_numpy() / np.maximum(1, pc.utf8_length(texts).to_numpy())
        columns = (np.log1p(n), hits / per, strong / per, weight / per, np.log1p(hits), near / per, you / per, capitals / per, marks / per, points / per, symbols / per, hidden / per, np.where(n > 0, digits, 0), np.maximum.reduceat(rows[:, 2], starts))
        for k, c in enumerate(columns):
            out[:, k] = c
        return out


@dataclass
class Model:
    lexicon: dict[str, float]
    start: float
    trees: list[Tree]
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(margin(self.start, self.trees, x), *self.knots), 0.0, 1.0)


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on labelled rows whose crc32 of the id modulo 5 is not 0, at most about ``per_class`` of each label. Two
    thirds of them, by a hash of the id, grow the trees and the lexicon; the others calibrate."""
    sample = labelled_sample(docs, labels, "toxic", split_of("doc_id", 5) != 0, per_class)
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3))
    words = lexicon(sample.filter(part > 0))

    def run(batches):
        f = Features(words)
        for b in slices(batches, limit=2_000_000):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(list(f.of(b.column(1))), pa.list_(pa.float64()))], names=["doc_id", "label", "part", "x"])

    rows = map_texts(sample.select("doc_id", "text", "label", part.cast("int").alias("part")), run, "doc_id long, label int, part int, x array<double>").toPandas().sort_values("doc_id")
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    y, grow = rows["label"].to_numpy(float), rows["part"].to_numpy() > 0
    if len(np.unique(y)) < 2:
        only = float(y[0]) if len(y) else 0.0
        return Model(words, 0.0, [], (np.array([0.0, 1.0]), np.array([only, only])))
    start, trees = boost(x[grow], y[grow], rounds=40, depth=3)
    rest = ~grow if len(np.unique(y[~grow])) == 2 else grow
    return Model(words, start, trees, isotonic(margin(start, trees, x[rest]), y[rest]))


def classify(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text. A null or empty text has features of 0; repeated rows
    stay; an empty table gives no rows; extra columns are not read."""

    def run(batches):
        f = Features(model.lexicon)
        for b in slices(batches, limit=2_000_000):
            s = model.score(f.of(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (split_of("doc_id", 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_texts(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below ``cut``."""
    at = docs.columns.index("text")

    def run(batches):
        f = Features(model.lexicon)
        for b in slices(batches, limit=2_000_000):
            yield b.filter(pa.array(model.score(f.of(b.column(at))) < cut))

    return map_texts(docs, run, docs.schema)


def run(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, learn(docs, labels))
