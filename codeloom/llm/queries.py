"""One registered query for each operator, and SQL where it can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import (
    ann,
    bpe,
    langid,
    merkle,
    packing,
    prefixcounts,
    quality,
    rules,
    secrets,
    simhash,
    substring,
    toxicity,
    trie,
)
from codeloom.llm.common import documents, remainder
from codeloom.llm.textstats import COUNTS, labelled, text_statistics
from codeloom.session import materialize


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _held_out(of: int, held: int):
    return F.coalesce(remainder(F.col("doc_id"), of) == held, F.lit(False)).alias("held_out")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = bpe.word_tokenizer()
    out = bpe.decode(bpe.encode(documents(spark, sf_dir), spec), spec)
    return out.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = secrets.versions(documents(spark, sf_dir))
    ledger = materialize(secrets.scan(seen), "secret-ledger")
    found = secrets.findings(seen, ledger)
    counts = [secrets.count_of(F.col("findings"), r.kind).alias(f"n_{r.kind}") for r in secrets.RULES]
    return found.select(F.col("path").alias("doc_id"), *counts, secrets.spans_text(F.col("findings")).alias("spans")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans"
    )


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = langid.predict(docs, langid.fit(docs))
    return out.select("doc_id", _held_out(5, 0), "lang_pred", "score", "accepted")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(documents(spark, sf_dir), bpe.word_tokenizer())
    return out.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(text_statistics(documents(spark, sf_dir)), "text-statistics")
    learned = rules.fit(labelled(stats, _labels(spark, sf_dir), "quality"))
    failed = rules.base_failed()
    return stats.select(
        "doc_id", *COUNTS, failed.alias("base_failed"), (~failed & rules.verdict(learned)).alias("kept")
    )


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = toxicity.predict(docs, toxicity.fit(docs, _labels(spark, sf_dir)))
    return out.select("doc_id", _held_out(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(text_statistics(documents(spark, sf_dir)), "text-statistics")
    examples = labelled(stats.where(remainder(F.col("doc_id"), 4) != 2), _labels(spark, sf_dir), "quality")
    model = quality.fit(examples.where("y IN (0, 1)"))
    out = quality.score(stats, model, ["doc_id"])
    return out.select("doc_id", _held_out(4, 2), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.search(vectors, F.col("vec_id") % 20 == 0)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    others = [F.col("doc_id"), F.col("source"), F.col("lang")]
    leaf = merkle.digest(*others, F.col("n_chars"), F.col("text"))
    changed = F.coalesce(remainder(F.col("doc_id"), 7) == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    other = F.when(changed, merkle.digest(*others, F.col("n_chars") + 1, F.col("text")))
    given = docs.select("doc_id", "lang", leaf.alias("leaf"), other.alias("other"))
    proofs = merkle.manifest(given, "lang", "doc_id", "leaf", "doc_id", "other")
    proofs = proofs.withColumn("used", F.coalesce("other", "leaf"))
    return merkle.verified(proofs, "used").select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_prefixcounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = prefixcounts.prefix_counts(documents(spark, sf_dir), prefixcounts.piece_model())
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe,
        op2_secrets,
        op3_language,
        op4_packing,
        op5_rules,
        op6_substring,
        op7_toxicity,
        op8_quality,
        op9_neighbours,
        op10_simhash,
        op11_merkle,
        op12_trie,
        op13_prefixcounts,
        pipeline,
    )
}

_SPACE = r"\x20\x09-\x0D"


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYWORD = "|".join(map(_either_case, ["password", "passwd", "secret", "token", "api_?key"]))
_ASSIGN = rf"""(?:{_KEYWORD})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _matches(kind: str, number: int, pattern: str, holds: str) -> str:
    return f"""
  SELECT doc_id, '{kind}' AS kind, {number} AS kind_no,
         length(array_to_string(pieces[1:i], '')) + length(array_to_string(found[1:i-1], '')) AS s,
         length(found[i]) AS n
  FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS pieces, regexp_extract_all(t, '{pattern}') AS found,
               regexp_extract_all(t, '{pattern}', {1 if kind == "assign" else 0}) AS part FROM d),
       LATERAL (SELECT unnest(range(1, len(found) + 1)) AS i)
  WHERE {holds}"""


OP2_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({_matches("assign", 0, _ASSIGN, "length(part[i]) >= 8")}
  UNION ALL {_matches("access", 1, "AKIA[A-Z0-9]+", "length(found[i]) >= 16")}
  UNION ALL {_matches("hex", 2, "[0-9a-f]{32,}", "true")}),
shown AS (
  SELECT doc_id, count(*) FILTER (kind_no = 0) AS a, count(*) FILTER (kind_no = 1) AS b, count(*) FILTER (kind_no = 2) AS h,
         string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, kind_no) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN shown USING (doc_id)
"""

OP6_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i AS s, array_to_string(ws[i:i+19], ' ') AS words
  FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 18)) AS i)),
later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY words ORDER BY doc_id, s) AS n FROM win)
  WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i FROM later, LATERAL (SELECT unnest(range(s, s + 20)) AS i)),
word AS (SELECT doc_id, i, ws[i] AS word FROM w, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i)),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS words
  FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""



def _crc32(text: str) -> str:
    """CRC-32 of ASCII text, bit by bit; 3988292384 is its polynomial."""
    bits = "list_reduce(list_prepend(xor(a, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, n: xor(v >> 1, 3988292384 * (v & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, c: {bits}), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || {value}, '-')"


def _levels(name: str, group: str, start: str) -> str:
    return f"""{name} AS (
  {start} UNION ALL
  SELECT {group}, level + 1, [sha256(array_to_string(nodes[j:j+1], '')) FOR j IN range(1, len(nodes) + 1, 2)]
  FROM {name} WHERE len(nodes) > 1)"""


_LEAF = "sha256(" + " || ".join(map(_field, ["doc_id", "source", "lang", "n_chars + {0}", "text"])) + ")"
_STEP = "CASE WHEN xor({0} >> level, 1) < ({0} >> level) THEN 'L' ELSE 'R' END || coalesce(nodes[xor({0} >> level, 1) + 1], '')"

OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
  FROM (SELECT doc_id, lang, {_LEAF.format(0)} AS leaf,
               CASE WHEN doc_id IS NOT NULL AND {_crc32("doc_id::VARCHAR")} % 7 = 0 THEN {_LEAF.format(1)} ELSE {_LEAF.format(0)} END AS used
        FROM documents)),
{_levels("low", "lang", "SELECT lang, 0 AS level, list(leaf ORDER BY i) AS nodes FROM d GROUP BY lang")},
subs AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k FROM low WHERE len(nodes) = 1),
{_levels("top", "g", "SELECT 0 AS g, 0 AS level, list(subroot ORDER BY k) AS nodes FROM subs")},
steps AS (
  SELECT d.lang, i, level, {_STEP.format("i")} AS step FROM d JOIN low ON d.lang IS NOT DISTINCT FROM low.lang WHERE len(nodes) > 1
  UNION ALL
  SELECT d.lang, i, 1000 + level, {_STEP.format("k")} FROM d JOIN subs ON d.lang IS NOT DISTINCT FROM subs.lang, top WHERE len(nodes) > 1),
paths AS (SELECT lang, i, list(step ORDER BY level) AS path FROM steps GROUP BY lang, i),
folded AS (
  SELECT doc_id, leaf, subroot, nodes[1] AS root,
         sha256(array_to_string(list_transform(coalesce(path, []), lambda s: s[2:]), '')) AS proof_sha256,
         list_reduce(list_prepend(used, coalesce(path, [])),
                     lambda a, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || a ELSE a || s[2:] END)) AS folded_root
  FROM d JOIN subs ON d.lang IS NOT DISTINCT FROM subs.lang
  LEFT JOIN paths ON d.lang IS NOT DISTINCT FROM paths.lang AND d.i = paths.i, top WHERE len(nodes) = 1)
SELECT *, folded_root = root AS verified FROM folded
"""

OP12_SQL = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
         sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said,
         len(regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, {_crc32("conv_id::VARCHAR")} % 4 AS h FROM t),
turns AS (
  SELECT ids.conv_id, 0 AS own, pos, said, words FROM ids JOIN t ON t.conv_id = ids.conv_id - ids.conv_id % 20 AND pos < h
  UNION ALL SELECT conv_id, 1, pos, said, words FROM t JOIN ids USING (conv_id) WHERE pos >= h),
convs AS (
  SELECT conv_id, coalesce(all_said, []) AS said, coalesce(all_words, []) AS words
  FROM ids LEFT JOIN (SELECT conv_id, list(said ORDER BY own, pos) AS all_said, list(words ORDER BY own, pos) AS all_words
                      FROM turns GROUP BY conv_id) USING (conv_id)),
members AS (
  SELECT conv_id, d, array_to_string(said[1:d], '') AS node, d = len(said) AS last, CASE WHEN d = 0 THEN 0 ELSE words[d] END AS words
  FROM convs, LATERAL (SELECT unnest(range(0, len(said) + 1)) AS d)),
nodes AS (
  SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '') AS ends
  FROM members GROUP BY node, d),
kids AS (SELECT left(node, length(node) - 64) AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
whole AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN kids USING (node)),
sums AS (
  SELECT left(node, 64 * up) AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM whole, LATERAL (SELECT unnest(range(0, depth + 1)) AS up) GROUP BY 1)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, sha256(w.ends) AS ends_sha256
FROM whole w JOIN sums USING (node) LEFT JOIN whole p ON w.depth > 0 AND p.node = left(w.node, length(w.node) - 64)
"""

ORACLES = {"op2_secrets": OP2_SQL, "op6_substring": OP6_SQL, "op11_merkle": OP11_SQL, "op12_trie": OP12_SQL}
