"""Statistics of whole texts, for the quality operators.

One pass over each text, where it lies. Null texts count as empty.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from codeloom.llm.common import columns, map_rows

# Fixed values -----------------------------------------------------------------

SYMBOLS = "#*$%&|<>"

# ------------------------------------------------------------------------------

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = [
    "log_words",
    "mean_word",
    "long_words",
    "symbols",
    "symbol_words",
    "dup_lines",
    "repeat_words",
    "distinct_words",
    "top_word",
    "upper",
    "digits",
    "punctuation",
    "line_words",
    "end_marks",
    "same_neighbours",
    "short_words",
    "accents",
    "pipes",
]
SCHEMA = ", ".join([f"{c} long" for c in COUNTS] + [f"{c} double" for c in SHARES])
_SYMBOL = re.compile(f"[{re.escape(SYMBOLS)}]")
_SYMBOL_BYTE = re.compile(_SYMBOL.pattern.encode())
_UPPER, _DIGIT, _MARK, _ACCENT = re.compile(r"[A-Z]"), re.compile(r"[0-9]"), re.compile(r"[!?;:,.]"), re.compile(r"[^\x00-\x7f]")
_END = re.compile(rb"[.!?]\s*\Z")


def repeated_words(numbers: np.ndarray, distinct: int) -> int:
    """Words inside a window of three that the text holds twice or more."""
    if len(numbers) < 4:
        return 0
    pairs = np.unique(numbers[:-1] * distinct + numbers[1:], return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * distinct + numbers[2:]
    _, where, n = np.unique(windows, return_inverse=True, return_counts=True)
    twice = n[where] >= 2
    covered = np.zeros(len(numbers), bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def statistics(text: str | None) -> tuple:
    """Counts, then shares, in the order of ``SCHEMA``."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n, index = len(words), {}
    numbers = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    times = np.bincount(numbers, minlength=1) if n else np.zeros(1, np.int64)
    lines = [x for x in raw.split(b"\n") if x.split()]
    per_line = Counter(lines)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols, dup, repeat = len(_SYMBOL.findall(text)), len(lines) - len(per_line), repeated_words(numbers, len(index))
    sizes = np.fromiter(map(len, words), np.int64, n)
    same = int((numbers[1:] == numbers[:-1]).sum()) if n > 1 else 0
    marked = np.fromiter((bool(_SYMBOL_BYTE.search(w)) for w in index), bool, len(index))
    w, c, k = max(1, n), max(1, chars), max(1, len(lines))
    return (
        n,
        chars,
        symbols,
        dup,
        repeat,
        float(np.log1p(n)),
        chars / w,
        float((sizes > 12).sum()) / w,
        symbols / c,
        float(marked[numbers].sum()) / w if n else 0.0,
        dup / k,
        repeat / w,
        len(index) / w,
        float(times.max()) / w,
        len(_UPPER.findall(text)) / c,
        len(_DIGIT.findall(text)) / c,
        len(_MARK.findall(text)) / c,
        n / k,
        sum(bool(_END.search(x)) * m for x, m in per_line.items()) / k,
        same / w,
        float((sizes < 3).sum()) / w,
        len(_ACCENT.findall(text)) / c,
        text.count("|") / w,
    )


def text_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the columns of ``SCHEMA``, a row for each row."""
    rows = columns(docs, doc_id=doc_id, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        for d, t in it:
            yield d, *statistics(t)

    return map_rows(rows, run, f"doc_id {kind}, {SCHEMA}")


def labelled(stats: DataFrame, labels: DataFrame, label: str, doc_id: str = "doc_id") -> DataFrame:
    """Statistics with their non-null labels as ``y``; several labels of a document give several rows."""
    known = columns(labels, doc_id=doc_id, y=label).where("doc_id IS NOT NULL AND y IS NOT NULL")
    return stats.join(known, "doc_id").withColumn("y", known["y"].cast("int"))
