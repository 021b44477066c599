"""Token ids of whole texts by the tokenizers library, as little-endian unsigned 32-bit bytes.

The pre-tokenizer of a byte-level vocabulary always starts a piece at a single space between two characters that are
not white space, so a text is cut there into chunks, and a chunk has the same ids wherever it stands. Arrow splits a
slice of texts into chunks and its distinct chunks into pieces; only pieces that no cache knows are worked out, by
the library's model; Arrow strings the results together again.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 0
PIECES = 200_000  # pieces that a generation of the cache holds
SLICE = 3_000_000  # bytes of text that are worked on at once, about
# Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Arrow's form of it, for strings up to LATIN (the last letter of the blocks whose classes are the same in all Unicode
# versions) without white space in a row; others are cut by the pattern itself.
LATIN = "ɏ"
_SPACE = r"\x09-\x0D\x20\x{85}\x{A0}"
_ARROW_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]"
_OTHERS = rf"[^\x00-\x{{24F}}]|[{_SPACE}][{_SPACE}]"
# No place to cut: a space before or after an empty chunk or white space (of any definition).
_WIDE = _SPACE + r"\x1C-\x1F\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_EDGES = rf"^$|^[{_WIDE}]|[{_WIDE}]$"
# Byte-level vocabularies spell a byte by a character: its own if that is printable, else the next one from 256 on.
_PRINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SIGNS = {b: chr(b) for b in _PRINTS} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTS)}
SPELLING = {c: "".join(_SIGNS[b] for b in chr(c).encode()) for c in range(ord(LATIN) + 1)}
BETWEEN = "\ue000"
_EMPTY, _ONE_SPACE = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
_CUT = re.compile(r"(?<=\S) (?=\S)")
_made: dict[tuple[str, bool], "IdEncoder"] = {}


class Recent:
    """A bounded cache of two generations: when the young one is full it becomes the old one, and what is asked for
    again moves back, so frequent keys stay. ``make`` works out the values of a list of keys."""

    def __init__(self, make: Callable[[list[str]], list[Any]], limit: int):
        self.make, self.limit, self.young, self.old = make, limit, {}, {}

    def table(self, keys: Iterable[str]) -> dict[str, Any]:
        """A table that has the values of all ``keys``."""
        new = [k for k in keys if k not in self.young]
        if new and self.young and len(self.young) + len(new) > self.limit:
            self.old, self.young, new = self.young, {}, keys
        young, old = self.young, self.old
        todo = []
        for k in new:
            if k in old:
                young[k] = old[k]
            else:
                todo.append(k)
        if todo:
            young.update(zip(todo, self.make(todo)))
        return young


def _flags(x: pa.Array) -> np.ndarray:
    return pc.fill_null(x, False).to_numpy(zero_copy_only=False)


def _strung(values: pa.Array, at: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The byte strings ``values[at]``, those between two ``starts`` joined to one."""
    data = values.take(pa.array(at))
    ends = np.frombuffer(data.buffers()[1], np.int64)[: len(at) + 1][starts]
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends)), data.buffers()[2]])


class Pieces:
    """Bytes of texts, piece by piece. ``make`` works out a list of pieces, ``whole`` a list of strings that it cuts by
    the pattern: for each a byte string, or a tuple of ``columns`` of them if that is more than 1."""

    def __init__(self, make: Callable[[list[str]], list], whole: Callable[[list[str]], list], columns: int):
        self.whole, self.columns, self.recent = whole, columns, Recent(make, PIECES)

    def column(self, values: list, k: int) -> pa.Array:
        return pa.array(values if self.columns == 1 else [v[k] for v in values], pa.large_binary())

    def strings(self, strings: pa.Array) -> list[pa.Array]:
        """For each column the bytes of strings that are a place's whole chunk."""
        others = _flags(pc.match_substring_regex(strings, _OTHERS))
        marked = pc.replace_substring_regex(pc.if_else(pa.array(others), "", strings), _ARROW_PATTERN, rf"\0{BETWEEN}")
        parts = pc.split_pattern(pc.utf8_rtrim(marked, BETWEEN), BETWEEN)
        coded = parts.flatten().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        known = self.recent.table(pieces)
        values = list(map(known.__getitem__, pieces))
        at, starts = coded.indices.to_numpy(), parts.offsets.to_numpy()
        made = self.whole(strings.filter(pa.array(others)).to_pylist()) if others.any() else []
        out = []
        for k in range(self.columns):
            x = _strung(self.column(values, k), at, starts)
            if made:
                place = np.arange(len(strings))
                place[others] = len(strings) + np.arange(len(made))
                x = pa.concat_arrays([x, self.column(made, k)]).take(pa.array(place))
            out.append(x)
        return out

    def of(self, texts: pa.Array) -> list[list[memoryview | bytes]]:
        """For each column the bytes of each text; none for a null or empty text."""
        out: list[list] = [[b""] * len(texts) for _ in range(self.columns)]
        texts = texts.cast(pa.large_string())
        live = np.flatnonzero(_flags(pc.greater(pc.binary_length(texts), 0)))
        if not len(live):
            return out
        texts = texts.take(pa.array(live))
        words = pc.split_pattern(texts, " ")
        first = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        at, size = coded.indices.to_numpy().astype(np.int64), np.diff(first)
        odd = np.logical_or.reduceat(_flags(pc.match_substring_regex(coded.dictionary, _EDGES))[at], first[:-1])
        for i in np.flatnonzero(odd).tolist():  # texts with white space beside a space are cut at their other spaces
            head, *rest = _CUT.split(texts[i].as_py())
            made = self.whole([head, *(" " + c for c in rest)])
            for column, x in zip(out, [made] if self.columns == 1 else zip(*made)):
                column[live[i]] = b"".join(x)
        if odd.all():
            return out
        at, first = at[np.repeat(~odd, size)], np.concatenate([[0], np.cumsum(size[~odd])])
        heads = coded.dictionary.take(pa.array(at[first[:-1]]))
        at[first[:-1]] = len(coded.dictionary) + np.arange(len(heads))
        each = self.strings(pa.concat_arrays([pc.binary_join_element_wise(_EMPTY, coded.dictionary, _ONE_SPACE), heads]))
        for column, values in zip(out, each):
            _, ends, data = _strung(values, at, first).buffers()
            ends, data = np.frombuffer(ends, np.int64).tolist(), memoryview(data).cast("B")
            for i, start, end in zip(live[~odd].tolist(), ends, ends[1:]):
                column[i] = data[start:end]
        return out


class IdEncoder:
    """Ids of texts. ``plain`` reads the strings of special tokens in a text as ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.special = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = Pieces(self.fresh, self.library, 1)

    def library(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts."""
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def fresh(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces by the library's model alone, as they need no pre-tokenizer."""
        spelled, model = BETWEEN.join(pieces).translate(SPELLING).split(BETWEEN), self.tokenizer.model.tokenize
        return [array("I", [t.id for t in model(x)]).tobytes() for x in spelled]

    def encode(self, texts: pa.Array) -> list[memoryview | bytes]:
        """Ids of each text; none for a null or empty one. A text with the string of a special token is not cut."""
        whole = np.zeros(len(texts), bool)
        for s in self.special:
            whole |= _flags(pc.match_substring(texts, s))
        if not whole.any():
            return self.pieces.of(texts)[0]
        out = self.pieces.of(pc.if_else(pa.array(whole), None, texts))[0]
        for i, x in zip(np.flatnonzero(whole).tolist(), self.library(texts.filter(pa.array(whole)).to_pylist())):
            out[i] = x
        return out


def encoder(path: str, plain: bool = False) -> IdEncoder:
    """One encoder for each worker process."""
    if (path, plain) not in _made:
        _made[path, plain] = IdEncoder(path, plain)
    return _made[path, plain]
