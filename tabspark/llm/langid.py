"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of its labelled text is built. A text is parsed greedily
into the longest phrases that occur in that sample; the language that needs the fewest phrases, normalised by how
many phrases held-back text of the language itself needs, wins. The automata are sparse tables: the rows of all
states lie over one another in one array, shifted so that no two entries meet, and an entry names its state. So the
alphabet holds every character of the training text, and every language that has a training text is learned.

All characters are parsed, and the phrases are those of one walk over the whole text. So that numpy can walk many
places at once, texts are cut into stretches of ``STRETCH`` characters that are first parsed each from a new phrase;
then the true parse goes on from every stretch into the next until it starts a phrase where the stretch's own parse
did too, from where both are the same.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, slices, split_of

SAMPLE_CHARS = 40_000  # characters of each language that its automaton is built from, at most
CHECK_CHARS = 10_000  # characters of each language that its norm is measured on, at most
HEAD_CHARS = 400  # characters that one training text gives, from a place anywhere in it, so that many texts count
ALL_CHARS = 2_000_000  # characters of all languages together, at most, so that the tables are small (about 40 bytes each)
BROADCAST = 100_000  # languages whose sizes are broadcast, at most; those of more are joined
STRETCH = 512


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every substring of ``text``."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in text:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


@dataclass
class Table:
    """Entry ``base[state] + symbol`` of ``state`` and ``to`` is a move, if ``state`` there is the state; else a new phrase starts in ``root[symbol]``."""

    base: np.ndarray
    state: np.ndarray
    to: np.ndarray
    root: np.ndarray

    def move(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and whether a new phrase starts. State 0 is that before any phrase and after a phrase of
        one unknown character."""
        at = self.base[state] + symbol
        new = (self.state[at] != state) | (state == 0)
        return np.where(new, self.root[symbol], self.to[at]), new


def table_of(text: np.ndarray, symbols: int = 0) -> Table:
    """Walk table for symbols below ``symbols``; symbol 0 is a character that no training text has, a phrase by itself."""
    moves = [{c: t for c, t in m.items() if c} for m in suffix_automaton(text.tolist())]
    width = max(symbols, int(text.max(initial=0)) + 1)
    total = sum(map(len, moves))
    state, to = np.full(2 * width + 2 * total, -1, np.int32), np.zeros(2 * width + 2 * total, np.int32)
    base, root = np.zeros(len(moves), np.int32), np.zeros(width, np.int32)
    for c, t in moves[0].items():
        root[c] = to[c] = t
        state[c] = 0
    low, end = width, width  # rows of other states start at ``width`` or later; entries below ``low`` are taken or passed over
    for s in sorted((s for s in range(1, len(moves)) if len(moves[s]) > 1), key=lambda s: -len(moves[s])):
        shape = np.fromiter(sorted(moves[s]), np.int64, len(moves[s]))
        shape -= shape[0]
        at = low
        while True:
            while at + shape[-1] + 256 >= len(state):
                state, to = np.append(state, np.full(len(state), -1, np.int32)), np.append(to, np.zeros(len(to), np.int32))
            fits = np.flatnonzero((state[at + shape[:, None] + np.arange(256)] < 0).all(axis=0))
            if len(fits):
                at += int(fits[0])
                break
            at += 256
        if at >= low + 256:
            low += 256
        first = min(moves[s])
        base[s] = at - first
        for c, t in moves[s].items():
            state[base[s] + c], to[base[s] + c] = s, t
        end = max(end, at + int(shape[-1]) + 1)
    single = [s for s in range(1, len(moves)) if len(moves[s]) == 1]
    room = np.flatnonzero(state[width:end] < 0)[: len(single)] + width
    room = np.append(room, end + np.arange(len(single) - len(room)))
    size = max(end, int(room.max(initial=0)) + 1) + width
    state = np.append(state, np.full(max(0, size - len(state)), -1, np.int32))[:size]
    to = np.append(to, np.zeros(max(0, size - len(to)), np.int32))[:size]
    for s, p in zip(single, room.tolist()):
        ((c, t),) = moves[s].items()
        base[s], state[p], to[p] = p - c, s, t
    return Table(base, state, to, root)


def folded(text: str) -> np.ndarray:
    """Code points of a text in small letters, with runs of white space as one space."""
    return np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "replace"), np.uint32)


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether a code point is a letter; made once in each worker."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


@dataclass
class Model:
    languages: list[str]
    symbol: np.ndarray  # code point -> symbol
    tables: list[Table]
    norms: np.ndarray  # phrases per character of held-back text of the language

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """[text, language] phrases."""
        out = np.zeros((len(texts), len(self.languages)))
        parts, owner = [], []
        for i, t in enumerate(texts):
            s = self.symbol[t]
            for a in range(0, len(s), STRETCH):
                parts.append(s[a : a + STRETCH])
                owner.append(i)
        if not parts:
            return out
        order = np.argsort([-len(p) for p in parts], kind="stable")
        lane = np.argsort(order)  # of each part
        sizes = np.array([len(parts[i]) for i in order])
        lanes = np.zeros((sizes[0], len(parts)), np.int32)
        for k, i in enumerate(order):
            lanes[: sizes[k], k] = parts[i]
        live = len(parts) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), "right")
        own = np.asarray(owner)
        goes_on = np.flatnonzero(own[1:] == own[:-1]) + 1  # parts that are not the first of their text
        for k, table in enumerate(self.tables):
            state, starts = np.zeros(len(parts), np.int32), np.zeros(lanes.shape, bool)
            for step in range(sizes[0]):
                n = live[step]
                to, new = table.move(state[:n], lanes[step, :n])
                state[:n], starts[step, :n] = to, new
            found = starts.sum(axis=0, dtype=np.int64)[lane]
            if len(goes_on):
                found[goes_on] += self._joined(table, lanes, starts, sizes, state, lane, goes_on)
            out[:, k] = np.bincount(own, found, len(texts))
        return out

    @staticmethod
    def _joined(table: Table, lanes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, state: np.ndarray, lane: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """How many phrases more each of ``parts`` has when the parse of the part before goes on into it."""

        def walk(at: np.ndarray, s: np.ndarray):
            """Differences, states at the end and whether both parses met, of lanes ``at`` entered in states ``s``."""
            more, met, end = np.zeros(len(at), np.int64), np.zeros(len(at), bool), state[at].copy()
            todo, s = np.arange(len(at)), s.copy()
            for step in range(len(lanes)):
                todo, s = todo[keep := sizes[at[todo]] > step], s[keep]
                if not len(todo):
                    break
                to, new = table.move(s, lanes[step, at[todo]])
                own = starts[step, at[todo]]
                more[todo] += new.astype(np.int64) - own
                met[todo] = same = new & own
                end[todo[~same]] = to[~same]
                todo, s = todo[~same], to[~same]
            return more, end, met

        base, held, to, root = map(memoryview, (table.base, table.state, table.to, table.root))

        def walk_one(at: int, s: int) -> tuple[int, int, bool]:
            """The same of one lane, number by number: few lanes need it, one after the other."""
            more, size = 0, int(sizes[at])
            for c, own in zip(lanes[:size, at].tolist(), starts[:size, at].tolist()):
                k = base[s] + c
                new = s == 0 or held[k] != s
                more += new - own
                if new and own:
                    return more, int(state[at]), True
                s = root[c] if new else to[k]
            return more, s, False

        more, end, met = walk(lane[parts], state[lane[parts - 1]])
        place = {int(p): i for i, p in enumerate(parts)}
        for i in np.flatnonzero(~met).tolist():  # the next part was entered in a state that is not that of the true parse
            while not met[i] and (j := place.get(int(parts[i]) + 1)) is not None:
                more[j], end[j], met[j] = walk_one(int(lane[parts[j]]), int(end[i]))
                i = j
        return more

    def predict(self, texts: list[str | None], is_letter: np.ndarray) -> tuple[list[str], np.ndarray]:
        points = [folded(t) if t else np.zeros(0, np.uint32) for t in texts]
        known = np.array([bool(len(p)) and bool(is_letter[p].any()) for p in points], bool)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        cost = self.phrases(points) / np.maximum(1, np.array([len(p) for p in points]))[:, None] / self.norms
        best = cost.argmin(axis=1)
        low = cost[np.arange(len(best)), best]
        share = np.exp(-4 * (cost / np.maximum(low, 1e-9)[:, None] - 1))
        score = np.where(known, 1 / share.sum(axis=1), 0.0)
        return [self.languages[b] if k else "und" for b, k in zip(best, known)], np.clip(score, 0, 1)


def learn(docs: DataFrame, chars: int = SAMPLE_CHARS, check: int = CHECK_CHARS, head: int = HEAD_CHARS, total: int = ALL_CHARS) -> Model:
    """Fit on stretches of documents whose crc32 of the id modulo 5 is not 0, in the order of a hash of the id, with
    at most ``chars`` + ``check`` characters of each language that occurs (less each if all came to more than ``total``);
    a language with too little text to measure its norm gets the mean of the others'. A stretch starts at a place chosen by a hash
    of the id."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (split_of("doc_id", 5) != 0))
    sizes = known.groupBy("lang").agg(F.count("*").alias("size"))
    languages = sizes.count()
    sizes = F.broadcast(sizes) if languages <= BROADCAST else sizes  # a language and a number each
    share = min(1.0, total / max(1, (chars + check) * languages))
    chars, check = max(1, int(chars * share)), max(1, int(check * share))
    wanted = max(1, 4 * (chars + check) // head)  # texts of each language; some are short
    place = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1_000_003))
    start = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.greatest(F.length("text") - head + 1, F.lit(1))).cast("int") + 1
    chosen = known.select("lang", place.alias("place"), "doc_id", F.col("text").substr(start, F.lit(head)).alias("text"))
    chosen = chosen.join(sizes, "lang").filter(F.col("place") / F.lit(1_000_003.0) < wanted / F.col("size"))
    texts: dict[str, list[np.ndarray]] = {}
    for r in sorted(chosen.collect(), key=lambda r: (r["place"], r["doc_id"])):
        texts.setdefault(r["lang"], []).append(folded(r["text"]))
    langs = sorted(texts)
    train, held = {}, {}
    for x in langs:
        both = np.concatenate([np.append(t, 32) for t in texts[x]]).astype(np.uint32)[: chars + check]
        cut = max(1, len(both) * chars // (chars + check))
        train[x], held[x] = both[:cut], both[cut:]
    points = np.unique(np.concatenate([train[x] for x in langs] or [np.zeros(0, np.uint32)]))
    symbol = np.zeros(0x110000, np.int32)
    symbol[points] = np.arange(1, len(points) + 1)
    model = Model(langs, symbol, [table_of(symbol[train[x]], len(points) + 1) for x in langs], np.ones(len(langs)))
    norms = [Model([x], symbol, [t], np.ones(1)).phrases([held[x]])[0, 0] / len(held[x]) if len(held[x]) else np.nan for x, t in zip(langs, model.tables)]
    model.norms = np.where(np.isnan(norms), np.nanmean(norms) if np.isfinite(norms).any() else 1.0, norms) if langs else model.norms
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text. ``und`` and score 0 for a null text or one without a
    letter; repeated rows stay; an empty table gives no rows; extra columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        is_letter = letters()
        for b in slices(batches, limit=1_500_000):
            lang, score = shared.value.predict(b.column(2).to_pylist(), is_letter)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (split_of("doc_id", 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_texts(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def run(docs: DataFrame) -> DataFrame:
    return identify(docs, learn(docs))
