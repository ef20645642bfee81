"""BPE encoding and decoding with a given tokenizer file.

Short texts are encoded where they lie. A long text is cut into leaves that
travel as rows and are encoded in parallel. Neighbours are then concatenated
pairwise, as a tree: the text around each join is encoded again in a window that
grows until, on both sides, the window and the half agree on a run of tokens
(same ids, same places) or the window holds the whole half. A BPE encoding is
right if each pair of adjacent tokens is, so what agrees can be spliced exactly.

Null texts count as empty: no ids. Ids, nulls and repeated rows pass through, a
row in is a row out. Strings of special tokens in a text become their ids, as in
the library.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codeloom.llm.common import columns, map_rows, read_file, shared

#: Code points of a leaf; longer texts are cut.
LEAF = 1 << 15
#: Code points on each side of a join in the first window.
WINDOW = 64
#: Tokens that must agree. A code point has at most 4 bytes, so a run of 6 spans two code points.
AGREE = 6
#: Words whose ids a task remembers.
REMEMBERED = 300_000

# The settings of a word tokenizer file under which words of
# Latin-1 text can be cut here and looked up.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS, _NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
LATIN = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\x20\x09-\x0d\x85\xa0{_LETTERS}{_NUMBERS}]+"
)


class Tokens(NamedTuple):
    """A text with its ids and the places where each token starts and ends."""

    text: str
    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


class _Words(dict):
    def __init__(self, model):
        self.model = model
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in printed]
        self.letters = {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(other)}

    def __missing__(self, word: str) -> bytes:
        shown = word.encode().decode("latin-1").translate(self.letters)
        ids = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
        self[word] = ids
        return ids


class Encoder:
    def __init__(self, spec: str):
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        told = json.loads(spec)
        self.special = [t["content"] for t in told["added_tokens"]]
        self.words = _Words(self.tokenizer.model) if _cuts_latin_words(told) else None

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.words is not None and not any(s in text for s in self.special):
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                if len(self.words) > REMEMBERED:
                    self.words.clear()
                return b"".join([self.words[w] for w in LATIN.findall(text.lower())])
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def tokens(self, text: str) -> Tokens:
        e = self.tokenizer.encode(text, add_special_tokens=False)
        places = np.array(e.offsets, np.int64).reshape(-1, 2)
        return Tokens(text, np.array(e.ids, "<u4"), places[:, 0], places[:, 1])

    def decode(self, ids: bytes) -> str:
        return self.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)

    def joined(self, a: Tokens, b: Tokens) -> Tokens:
        """The tokens of the two texts as one."""
        text, cut, reach = a.text + b.text, len(a.text), WINDOW
        b = Tokens(b.text, b.ids, b.starts + cut, b.ends + cut)
        while True:
            low, high = _boundary(text, cut - reach, -1), _boundary(text, cut + reach, 1)
            w = self.tokens(text[low:high])
            w = Tokens(w.text, w.ids, w.starts + low, w.ends + low)
            left = (0, 0) if low == 0 else _agreed(a, w, low, cut, first=True)
            right = (len(b.ids), len(w.ids)) if high == len(text) else _agreed(b, w, cut, high, first=False)
            if left and right and left[1] <= right[1]:
                i, j, k, m = left[0], left[1], right[1], right[0]
                parts = [np.concatenate([x[:i], y[j:k], z[m:]]) for x, y, z in zip(a[1:], w[1:], b[1:])]
                return Tokens(text, *parts)
            reach *= 2

    def tree(self, leaves: list[Tokens]) -> Tokens:
        while len(leaves) > 1:
            pairs = [leaves[i : i + 2] for i in range(0, len(leaves), 2)]
            leaves = [self.joined(*p) if len(p) == 2 else p[0] for p in pairs]
        return leaves[0]


def _cuts_latin_words(told: dict) -> bool:
    normalizer, cutter, model = told["normalizer"] or {}, told["pre_tokenizer"] or {}, told["model"]
    steps, cuts = normalizer.get("normalizers", []), cutter.get("pretokenizers", [])
    return (
        [s["type"] for s in steps] == NORMALIZERS
        and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
        and (cuts[0]["pattern"], cuts[0]["behavior"], cuts[0]["invert"]) == ({"Regex": SPLIT}, "Removed", True)
        and not (cuts[1]["add_prefix_space"] or cuts[1]["use_regex"])
        and not model.get("dropout")
        and told["post_processor"] is None
    )


def _boundary(text: str, at: int, step: int) -> int:
    """The next place, outwards, where normalization doesn't act across."""
    while 0 < at < len(text):
        pair = text[at - 1 : at + 1]
        apart = unicodedata.normalize("NFC", pair[0]) + unicodedata.normalize("NFC", pair[1])
        if not unicodedata.combining(pair[1]) and unicodedata.normalize("NFC", pair) == apart:
            break
        at += step
    return min(max(at, 0), len(text))


def _agreed(half: Tokens, w: Tokens, low: int, high: int, first: bool) -> tuple[int, int] | None:
    """Places in the half and in the window, inside the first or last run that both have; None without one."""
    lo, hi = np.searchsorted(half.starts, low), np.searchsorted(half.ends, high, "right")
    there = {(half.starts[i], half.ends[i], half.ids[i]): i for i in range(lo, hi)}
    run, found, before = 0, None, None
    for j in range(len(w.ids)):
        i = there.get((w.starts[j], w.ends[j], w.ids[j]))
        run = 0 if i is None else run + 1 if before is not None and i == before + 1 else 1
        before = i
        if run >= AGREE:
            found = (i - AGREE // 2 + 1, j - AGREE // 2 + 1)
            if first:
                return found
    return found


@functools.lru_cache(maxsize=2)
def encoder(spec: str) -> Encoder:
    return Encoder(spec)


def word_tokenizer() -> str:
    """The tokenizer file that the queries use by default."""
    import public_tokenizers

    return read_file(public_tokenizers.path("word_bpe_49k.json"))


def encode(docs: DataFrame, spec: str, leaf: int = LEAF, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit); spec: a tokenizer file's content."""
    rows = columns(docs, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    kind, held = rows.schema["doc_id"].dataType.simpleString(), shared(docs, spec)
    long = F.length("text") > leaf

    def whole(it: Iterator[tuple]) -> Iterator[tuple]:
        e = encoder(held.value)
        for d, t in it:
            ids = e.ids(t)
            yield d, len(ids) // 4, ids

    def cut(it: Iterator[tuple]) -> Iterator[tuple]:
        for key, d, t in it:
            for part, at in enumerate(range(0, len(t), leaf)):
                yield key, d, part, t[at : at + leaf]

    def leaves(it: Iterator[tuple]) -> Iterator[tuple]:
        e = encoder(held.value)
        for key, d, part, t in it:
            x = e.tokens(t)
            yield key, d, part, t, *(np.asarray(c, "<u4").tobytes() for c in x[1:])

    def gathered(it: Iterator[tuple]) -> Iterator[tuple]:
        e, key, parts = encoder(held.value), None, []

        def done() -> Iterator[tuple]:
            if parts:
                ids = e.tree([p[1] for p in parts]).ids.astype("<u4").tobytes()
                yield parts[0][0], len(ids) // 4, ids

        for k, d, _, t, *cells in it:
            if k != key:
                yield from done()
                key, parts = k, []
            arrays = [np.frombuffer(c, "<u4") for c in cells]
            parts.append((d, Tokens(t, arrays[0], arrays[1].astype(np.int64), arrays[2].astype(np.int64))))
        yield from done()

    out = f"doc_id {kind}, n_tokens long, ids binary"
    pieces = map_rows(
        rows.where(long).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"),
        cut,
        f"key long, doc_id {kind}, part int, text string",
    )
    encoded = map_rows(
        pieces.repartition("key", "part"),
        leaves,
        f"key long, doc_id {kind}, part int, text string, ids binary, starts binary, ends binary",
    )
    merged = map_rows(encoded.repartition("key").sortWithinPartitions("key", "part"), gathered, out)
    return map_rows(rows.where(~long), whole, out).unionByName(merged)


def decode(encoded: DataFrame, spec: str) -> DataFrame:
    """The column ``ids`` as ``decoded`` text; null ids give null."""
    held, first = shared(encoded, spec), encoded.columns.index("ids")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        e = encoder(held.value)
        for row in it:
            yield *row, None if row[first] is None else e.decode(row[first])

    return map_rows(encoded, run, f"{schema}, decoded string")
