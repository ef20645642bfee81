"""Hashes of a text's tokens, from its bytes; the same tokens as those of the regex in ``tokens``."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from codeloom.functions.tokens import Specials, token_pattern

#: Bytes of texts whose tokens are told apart at a time; a longer text is alone.
BYTES = 1 << 20

_MARKERS = [s.encode() for s in Specials().ordered()]
_SPACE, _WORD, _OTHER, _LEAD, _REST = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*b"\t\n\x0b\f\r "]] = _SPACE
_KIND[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_"]] = _WORD
_KIND[0x80:0xC0], _KIND[0xC0:] = _REST, _LEAD
_VALUE = np.random.default_rng(11).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class TokenHashes:
    """64 bits for each token of a column of texts."""

    def __init__(self):
        self.powers = self.inverse = np.ones(1, np.uint64)
        self.split = re.compile(token_pattern()).findall

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First text, hashes, and the number of tokens up to the end of each text; null texts have none."""
        column = column.cast(pa.large_string())
        edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + BYTES, "right")) - 1)
            yield at, *self._of(data[edges[at] : edges[to]], edges[at : to + 1] - edges[at])
            at = to

    def _of(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if any(m in data.tobytes() for m in _MARKERS):
            return self._by_regex(data, edges)
        kind = _KIND[data]
        word = kind == _WORD
        edge = np.zeros(len(data) + 1, bool)
        edge[edges] = True
        first = (word & (edge[:-1] | ~np.concatenate([[False], word[:-1]]))) | (kind == _OTHER) | (kind == _LEAD)
        last = (word & (edge[1:] | ~np.concatenate([word[1:], [False]]))) | (kind == _OTHER)
        # A code point of several bytes ends where no further byte of it follows.
        rest = kind == _REST
        last |= ((kind == _LEAD) | rest) & ~np.concatenate([rest[1:], [False]])
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(begin) != len(end):  # not UTF-8
            return self._by_regex(data, edges)
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * self.powers[: len(data)], out=sums[1:])
        # Divided by the power of the place, so that equal tokens have equal hashes wherever they are.
        hashes = mixed((sums[end] - sums[begin]) * self.inverse[begin])
        return hashes, np.searchsorted(begin, edges[1:])

    def _by_regex(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        found = [self.split(raw[a:b].decode(errors="replace")) for a, b in zip(edges.tolist(), edges[1:].tolist())]
        return self.of_tokens([t for f in found for t in f]), np.cumsum([len(f) for f in found])

    def of_tokens(self, found: list[str]) -> np.ndarray:
        """Hashes of single tokens."""
        raw = [t.encode() for t in found]
        ends = np.cumsum([len(t) for t in raw], dtype=np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        self._grow(max(map(len, raw), default=0) + 1)
        begin = ends - np.diff(ends, prepend=0)
        place = np.arange(len(data)) - np.repeat(begin, np.diff(ends, prepend=0))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * self.powers[place], out=sums[1:])
        return mixed(sums[ends] - sums[begin])

    def _grow(self, size: int) -> None:
        if len(self.powers) < size:
            for name, base in (("powers", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
