"""Secret scans with an incremental ledger of blobs.

Every version of a file is addressed by the SHA-256 of its content. The ledger
holds a row for each scan: the blob, the rule versions that were applied, and
what they found. A scan takes each distinct blob once, leaves out the pairs of
blob and rule version that the ledger has, and returns the ledger's new rows.
Findings are joined back to every path by the blob's address.

Copies, also a third of all rows, meet in a partial aggregate before the
shuffle, so a task sends one of each. Null texts count as empty. Null paths
and repeated rows pass through. An empty table gives an empty ledger.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import columns, map_rows
from codeloom.session import materialize

FINDING = "array<struct<start: int, kind_no: int, kind: string, end: int, version: int>>"
#: Added to the rows of ``redact`` while it runs.
BLOB, FOUND = "__secret_blob__", "__secret_found__"
LEDGER = f"blob binary, rules array<string>, findings {FINDING}"


class Rule(NamedTuple):
    """A pattern, and what a match must also fulfil. A changed rule needs a new version."""

    kind: str
    version: int
    pattern: str
    holds: Callable[[re.Match], bool]

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# Fixed values -----------------------------------------------------------------

RULES = [
    Rule(
        "assign",
        1,
        r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        lambda m: len(m[2]) >= 8,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    Rule("hex", 1, r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
]

# ------------------------------------------------------------------------------


def versions(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """``path, text, blob``: each version with its content's address."""
    rows = columns(docs, path=path, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    return rows.withColumn("blob", F.unhex(F.sha2("text", 256)))


def scan(seen: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] = RULES) -> DataFrame:
    """New rows of the ledger for ``versions``; ``ledger`` has the earlier ones."""
    names = F.array(*[F.lit(r.name) for r in rules])
    blobs = seen.select("blob", "text").dropDuplicates(["blob"])
    if ledger is None:
        todo = blobs.withColumn("todo", names)
    else:
        done = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("done"))
        left = F.array_except(names, F.coalesce("done", F.array().cast("array<string>")))
        todo = blobs.join(done, "blob", "left").withColumn("todo", left).where(F.size("todo") > 0)

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        patterns = {r.name: (i, r, _compiled(r)) for i, r in enumerate(rules)}
        for blob, text, names in it:
            yield blob, names, _found(text, [patterns[n] for n in names])

    return map_rows(todo.select("blob", "text", "todo"), run, LEDGER)


def _compiled(rule: Rule) -> re.Pattern:
    # A run that starts the match is taken whole, so short ones fail in the pattern, which is faster.
    return re.compile(r"[0-9a-f]{32,}" if rule.pattern == r"[0-9a-f]+" else rule.pattern)


def _found(text: str, patterns: list[tuple[int, Rule, re.Pattern]]) -> list[dict]:
    spans = [
        {"start": m.start(), "kind_no": i, "kind": r.kind, "end": m.end(), "version": r.version}
        for i, r, p in patterns
        for m in p.finditer(text)
        if r.holds(m)
    ]
    return sorted(spans, key=lambda s: (s["start"], s["kind_no"]))


def findings(seen: DataFrame, ledger: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``path, findings`` of every version by the given rules' versions, ordered by start and kind; empty without any."""
    known = F.array(*[F.lit(r.name) for r in rules])
    per_scan = ledger.where(F.arrays_overlap("rules", known) & (F.size("findings") > 0))
    names = [r.name for r in rules]
    wanted = F.filter("findings", lambda f: F.concat_ws("@", f["kind"], f["version"]).isin(names))
    by_blob = per_scan.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(wanted))).alias("findings"))
    return (
        seen.select("path", "blob")
        .join(by_blob, "blob", "left")
        .select("path", F.coalesce("findings", F.array().cast(FINDING)).alias("findings"))
    )


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda f: f["kind"] == kind)).cast("long")


def spans_text(found: Column) -> Column:
    """kind:start:end, joined by commas."""
    shown = F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"]))
    return F.array_join(shown, ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", text: str = "text") -> DataFrame:
    """``docs`` with every found span, overlapping ones as one, replaced by ``mark``; null texts stay null."""
    ledger = materialize(scan(versions(docs, text, text)), "secret-ledger")
    found = ledger.where(F.size("findings") > 0).select(F.col("blob").alias(BLOB), F.col("findings").alias(FOUND))
    blob = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    joined = docs.withColumn(BLOB, blob).join(found, BLOB, "left")

    def replaced(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else _without(t, s, mark) for t, s in zip(texts, spans)], dtype=object)

    places = F.transform(FOUND, lambda f: F.array(f["start"], f["end"]))
    new = F.pandas_udf(replaced, "string")(F.col(text), places)
    return joined.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def _without(text: str, spans: list, mark: str) -> str:
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
