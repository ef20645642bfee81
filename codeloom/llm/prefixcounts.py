"""Exact token counts of every prefix of a text, by dynamic programming.

A BPE encoding is right if each two adjacent tokens are: encoding their joint
text alone gives the two again. So exactly one token can end at a place and
follow the last token of the prefix before it, and with that token the prefix's
count is the count before it plus one. One pass over a text finds the count of
every prefix (not of every part: a part may be cut differently). The counts are
kept as their changes, one signed byte a code point, so what is the longest
prefix of at most n tokens, or how many tokens a prefix has, is answered from
them and never encodes again.

No piece holds a space after another character, so a text falls apart into
words before runs of spaces, and a task remembers the changes of words.

Null texts count as empty, and empty texts have no tokens and no changes. A row
in is a row out: ids, nulls, ties and repeated rows pass through, an empty table
gives an empty one. Only the named columns are read, so others cannot clash. One
text and its changes are held in a task's memory, whatever their length.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from codeloom.llm.common import columns, map_rows, shared

#: Fixed value: what the library writes for a space.
SPACE = "\u2581"
#: Words and pairs of tokens that a task remembers, and code points of the longest word among them.
REMEMBERED, LONGEST_WORD = 600_000, 64


def piece_model() -> bytes:
    """The content of the model file that the query uses by default."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def require_supported(model: bytes) -> None:
    """Raises an error unless the model is BPE with byte fallback that only puts a space before a text."""
    from sentencepiece import sentencepiece_model_pb2 as schema

    told = schema.ModelProto.FromString(model)
    cleaning, training = told.normalizer_spec, told.trainer_spec
    if (
        training.model_type != schema.TrainerSpec.BPE
        or not training.byte_fallback
        or training.treat_whitespace_as_suffix
        or cleaning.precompiled_charsmap
        or not cleaning.add_dummy_prefix
        or cleaning.remove_extra_whitespaces
        or any(p.type in (p.USER_DEFINED, p.UNUSED) for p in told.pieces)
    ):
        raise ValueError("the model is not plain BPE with byte fallback and a space before the text")


class Counter:
    """Changes of the token count, code point by code point."""

    def __init__(self, model: bytes):
        m = SentencePieceProcessor(model_proto=model)
        known = [i for i in range(len(m)) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        scores = {m.id_to_piece(i): m.get_score(i) for i in known}
        order = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
        #: The order in which pieces are merged; equal scores are equal.
        self.ranks = {piece: order[score] for piece, score in scores.items()}
        found = defaultdict(set)
        for piece in self.ranks:
            if len(piece) > 2:
                found[piece[-3:]].add(len(piece))
        #: Lengths of the pieces that end in three given code points, long ones first, and those of any others.
        self.sizes = {end: (*sorted(n, reverse=True), 2, 1) for end, n in found.items()}
        letters = {c for piece in self.ranks for c in piece}
        apart = "".join(c for c in "\n\t" if c not in letters)
        spaced = all(SPACE not in piece.lstrip(SPACE) for piece in self.ranks)
        self.words = re.compile(f"[{apart}]|{SPACE}+[^{SPACE}{apart}]*|[^{SPACE}{apart}]+" if spaced and apart else "(?s:.+)")
        self.seen: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.halves: dict[str, tuple[int, str, str] | None] = {}

    def steps(self, text: str) -> np.ndarray:
        """How the count changes with each code point; an array of small integers as long as the text."""
        if not text:
            return np.empty(0, np.int8)
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        seen, parts = self.seen, []
        for word in self.words.findall(SPACE + text.replace(" ", SPACE)):
            part = seen.get(word)
            if part is None:
                part = self._word(word)
                if len(word) <= LONGEST_WORD:
                    seen[word] = part
            parts.append(part)
        padded = np.frombuffer(b"".join(parts), np.int8)
        out = padded[1:].copy()
        out[0] += padded[0]
        return out

    def _word(self, word: str) -> bytes:
        ranks, pairs, sizes = self.ranks, self.pairs, self.sizes
        counts, last, out = [0], [""], bytearray()
        for end in range(1, len(word) + 1):
            for size in sizes.get(word[max(0, end - 3) : end], (2, 1)):
                if size > end:
                    continue
                piece = word[end - size : end]
                if size > 1 and piece not in ranks:
                    continue
                before = last[end - size]
                follows = pairs.get((before, piece))
                if self._follows(before, piece) if follows is None else follows:
                    break
            else:
                raise ValueError(f"no token ends at {end} in {word!r}")
            last.append(piece)
            count = counts[end - size] + (1 if piece in ranks else len(piece.encode("utf-8", "replace")))
            out.append((count - counts[-1]) & 255)
            counts.append(count)
        return bytes(out)

    def _follows(self, before: str, piece: str) -> bool:
        """Both are tokens, and next to each other they stay as they are."""
        if len(self.pairs) > REMEMBERED:
            self.pairs.clear()
        known = self._merge(piece) is not None and (not before or self._apart(before, piece))
        self.pairs[before, piece] = known
        return known

    def _apart(self, a: str, b: str) -> bool:
        """No merge across the place between two tokens comes before those that made them.

        The merges are undone from the last to the first. ``limit`` is the rank
        that a merge across must stay below to have come before: below that of a
        left part, which comes first among equals, and up to that of a right part.
        """
        limit = len(self.ranks)
        while True:
            if self.ranks.get(a + b, limit) < limit:
                return False
            left, right = self._merge(a), self._merge(b)
            if left[0] > right[0]:
                limit, a = left[0], left[2]
            elif right[0] >= 0:
                limit, b = right[0] + 1, right[1]
            else:
                return True

    def _merge(self, piece: str) -> tuple[int, str, str] | None:
        """Rank and parts of the merge that makes a piece, rank -1 for a code point; None if none makes it."""
        if piece not in self.halves:
            parts = self._two_or_more(piece)
            self.halves[piece] = None if len(parts) > 2 else (self.ranks[piece], *parts) if len(parts) == 2 else (-1, "", "")
        return self.halves[piece]

    def _two_or_more(self, text: str) -> list[str]:
        """Parts before the last merge: the best pair is merged, the first of equals, while more than two are left."""
        parts = list(text)
        while len(parts) > 2:
            joint = [(self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ranks]
            if not joint:
                break
            at = min(joint)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


@functools.lru_cache(maxsize=2)
def counter(model: bytes) -> Counter:
    return Counter(model)


def prefix_counts(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``steps``: the change of the count with each code point, a byte each."""
    require_supported(model)
    rows = columns(docs, doc_id=doc_id, text=text)
    kind, held = rows.schema["doc_id"].dataType.simpleString(), shared(docs, model)

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        c = counter(held.value)
        for d, t in it:
            steps = c.steps(t or "")
            yield d, len((t or "").encode("utf-8", "replace")), int(steps.sum(dtype=np.int64)), steps.tobytes()

    return map_rows(rows, run, f"doc_id {kind}, n_bytes long, n_tokens long, steps binary")


def truncated(counts: DataFrame, budget: Column) -> DataFrame:
    """The columns of ``prefix_counts`` with ``kept_chars`` and ``kept_tokens``.

    They are those of the longest prefix of at most ``budget`` tokens, a column
    of ``counts``: zero and zero if none fits. A null budget keeps all.
    """
    names = counts.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.schema)
    at = names.index("steps")

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        for *row, most in it:
            counted = np.cumsum(np.frombuffer(row[at], np.int8), dtype=np.int64)
            fits = np.flatnonzero(counted <= most) if most is not None else np.arange(len(counted))
            kept = int(fits[-1]) + 1 if len(fits) else 0
            yield *row, kept, int(counted[kept - 1]) if kept else 0

    given = counts.select(*names, budget.cast("long").alias("__budget__"))
    return map_rows(given, run, f"{kinds}, kept_chars long, kept_tokens long")


def counts_at(counts: DataFrame, places: Column) -> DataFrame:
    """The columns of ``prefix_counts`` with ``counts``: the tokens of the prefixes of so many code points.

    ``places`` is a column of arrays; a place beyond the text counts as its end,
    a negative one as its start, a null one gives null.
    """
    names = counts.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.schema)
    at = names.index("steps")

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        for *row, wanted in it:
            counted = np.concatenate([[0], np.cumsum(np.frombuffer(row[at], np.int8), dtype=np.int64)])
            ends = [None if p is None else int(counted[min(max(p, 0), len(counted) - 1)]) for p in wanted or []]
            yield *row, ends

    given = counts.select(*names, places.cast("array<long>").alias("__places__"))
    return map_rows(given, run, f"{kinds}, counts array<long>")
