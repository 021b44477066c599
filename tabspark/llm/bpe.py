"""Byte-level BPE by prefix dynamic programming.

``last[i]`` is the one token that ends the encoding of the first i + 1 bytes of a piece: the token t ending there such
that the encoding of the bytes before t ends in a token that BPE leaves standing next to t. The whole encoding is read
back from the last entry. Appending bytes only adds entries; after an edit, entries before it stay valid. So pieces
are worked out in sorted order in one table, where each keeps the entries of what it shares with the piece before.
Whether two tokens stand next to each other is asked by undoing merges, from the highest rank downwards.
"""

from __future__ import annotations

import base64
from hashlib import sha256

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokenids import PATTERN, SLICE, Pieces

PAIRS = 1_000_000  # answers about pairs of tokens that are kept
_made: dict[tuple[str, str], "Codec"] = {}


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.rank = ranks
        self.bytes = {r: t for t, r in ranks.items()}
        self.size = {r: len(t) for t, r in ranks.items()}
        self.name = {r: b"%d " % r for r in ranks.values()}
        self.ends: dict[bytes, tuple[tuple[int, int], ...]] = {}  # of every ending of a token: (length, rank) of the tokens that it ends in, longest first
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.asked: dict[tuple[int, int], bool] = {}
        for token, r in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and (pair := self._last_merge(token, r)):
                self.parts[r] = pair
                self.merged[pair] = r
        for ending in sorted({t[i:] for t in ranks for i in range(len(t))}, key=len):
            shorter = self.ends.get(ending[1:], ())
            self.ends[ending] = ((len(ending), ranks[ending]), *shorter) if ending in ranks else shorter

    def _last_merge(self, token: bytes, below: int) -> tuple[int, int] | None:
        """The two tokens that BPE, using ranks under ``below`` only, leaves of ``token``."""
        left = [bytes([x]) for x in token]
        while len(left) > 2:
            best = min(((self.rank.get(a + b, below), i) for i, (a, b) in enumerate(zip(left, left[1:]))))
            if best[0] >= below:
                return None
            i = best[1]
            left[i : i + 2] = [left[i] + left[i + 1]]
        return self.rank[left[0]], self.rank[left[1]]

    def stands(self, pair: tuple[int, int]) -> bool:
        """True if the bytes of the two tokens together are encoded as these two again."""
        known = self.asked.get(pair)
        if known is None:
            if len(self.asked) >= PAIRS:
                self.asked.clear()
            known = self.asked[pair] = self._stands(*pair)
        return known

    def _stands(self, a: int, b: int) -> bool:
        limit = len(self.bytes) + 1
        while True:
            if (m := self.merged.get((a, b))) is not None and m < limit:
                return False
            if a > b:
                limit = a
                if a not in self.parts:
                    return True
                a = self.parts[a][1]
                if a == limit:
                    return True
            else:
                limit = b + 1
                if b not in self.parts:
                    return True
                b = self.parts[b][0]
            # the side that was undone keeps the part next to the border


class Prefixes:
    """The table of one piece that grows and changes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> "Prefixes":
        self.data += more
        data, last, ends, asked = self.data, self.last, self.v.ends, self.v.asked
        for end in range(len(last) + 1, len(data) + 1):
            start, found = end - 1, ()
            while start >= 0 and (more := ends.get(data[start:end])) is not None:
                found = more
                start -= 1
            for size, token in found:
                if size == end:
                    break
                known = asked.get(pair := (last[end - size - 1], token))
                if known or (known is None and self.v.stands(pair)):
                    break
            last.append(token)
        return self

    def edit(self, at: int, removed: int, added: bytes) -> "Prefixes":
        """Replace bytes; only prefixes that reach past ``at`` are worked out again."""
        rest = self.data[at + removed :]
        self.data = self.data[:at]
        del self.last[at:]
        return self.append(added + rest)

    def become(self, data: bytes) -> "Prefixes":
        """Change to ``data``, keeping the entries of the bytes that both begin with."""
        same = 0
        for a, b in zip(self.data, data):
            if a != b:
                break
            same += 1
        return self.edit(same, len(self.data) - same, data[same:])

    def ids(self) -> tuple[int, ...]:
        out, end, size = [], len(self.data), self.v.size
        while end:
            token = self.last[end - 1]
            out.append(token)
            end -= size[token]
        return tuple(out[::-1])


class Codec:
    """Encodes texts piece by piece (each match of the pattern) and keeps what it learns of pieces in a bounded cache.
    Texts are first cut at spaces under the pattern of ``tokenids`` only, which allows that."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.v = Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
        self.find = regex.compile(pattern).findall
        self.pieces = Pieces(self.fresh, self.whole, 2)
        self.cuts = pattern == PATTERN

    def ids(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """Ids of pieces, worked out in sorted order in one table."""
        data = [p.encode("utf-8", "replace") for p in pieces]
        ids, table = {}, Prefixes(self.v)
        for x in sorted(data):
            known = self.v.rank.get(x)
            ids[x] = (known,) if known is not None else table.become(x).ids()
        return [ids[x] for x in data]

    def fresh(self, pieces: list[str]) -> list[tuple[bytes, bytes]]:
        """Of pieces: the ids in decimal, a space after each, and the bytes that they stand for."""
        name = self.v.name
        return [(b"".join(map(name.__getitem__, ids)), self.decode(ids)) for ids in self.ids(pieces)]

    def whole(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """The same of texts that are cut by the pattern here."""
        cut = [self.find(t) for t in texts]
        known = self.pieces.recent.table(set().union(*cut))
        return [(b"".join([known[p][0] for p in c]), b"".join([known[p][1] for p in c])) for c in cut]

    def columns(self, texts: pa.Array) -> list[list[memoryview | bytes]]:
        """What ``fresh`` says, of each text, in two columns."""
        if self.cuts:
            return self.pieces.of(texts)
        return [list(x) for x in zip(*self.whole([t or "" for t in texts.to_pylist()]))]

    def encode(self, text: str) -> list[int]:
        return [x for ids in self.ids(self.find(text)) for x in ids]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.v.bytes.__getitem__, ids))


def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process, vocabulary and pattern."""
    if (path, pattern) not in _made:
        _made[path, pattern] = Codec(path, pattern)
    return _made[path, pattern]


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of whole texts; the second digest is of the decoded ids.

    A null text counts as empty; repeated rows stay; an empty table gives no rows; other columns are not read.
    """

    def run(batches):
        c = codec(path, pattern)
        for b in slices(batches, limit=SLICE, rows=8192):
            told, back = c.columns(b.column(1))
            n = [bytes(x).count(b" ") for x in told]
            names, data = [sha256(x[:-1]).hexdigest() for x in told], [sha256(x).hexdigest() for x in back]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(names, pa.string()), pa.array(data, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """All columns of ``df`` and an array of ids; null for a null text. ``out_col`` must not be a column yet."""
    ids = F.pandas_udf(lambda x: x.map(lambda s: None if s is None else codec(path, pattern).encode(s)), "array<int>")
    return df.withColumn(out_col, ids(F.col(text_col)))


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns of ``df`` and the bytes that the ids stand for; null for null ids."""
    back = F.pandas_udf(lambda x: x.map(lambda s: None if s is None else codec(path, pattern).decode(s)), "binary")
    return df.withColumn(out_col, back(F.col(ids_col)))
