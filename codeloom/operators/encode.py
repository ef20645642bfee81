"""Training examples: preparation, vocabulary, ids."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as t
from codeloom.functions.tokens import Specials, count_tokens, tokens
from codeloom.operators import filters as p
from codeloom.operators.dedup import by_text
from codeloom.operators.sample import SEED, exact_sample
from codeloom.session import materialize


@dataclass(frozen=True)
class EncodeOptions:
    """``simple_input``: the doc and signature are the input, the body is the label.

    ``first_line``: keep the first sentence of the documentation only.
    """

    simple_input: bool = False
    first_line: bool = False
    fraction: float = 1.0
    seed: int = SEED
    max_length: int = p.MAX_TOKENS
    min_doc_tokens: int = p.MIN_DOC_TOKENS
    vocabulary_size: int = 50_000
    specials: Specials = field(default_factory=Specials)


def with_texts(functions: DataFrame, specials: Specials = Specials()) -> DataFrame:
    """Wrapped documentation, the model's input and output, and the complete function."""
    doc, sig, body = F.col("documentation"), F.col("signature"), F.col("body")
    return functions.withColumn("documentation", t.wrap_doc(doc)).select(
        "*",
        t.model_input(doc, sig, specials.bos).alias("simple_input"),
        t.model_output(body, specials.eos).alias("simple_output"),
        t.complete_function(doc, sig, body, specials.bos, specials.eos).alias("complete_function"),
    )


def is_encodable(
    max_tokens: int = p.MAX_TOKENS,
    min_doc_tokens: int = p.MIN_DOC_TOKENS,
    specials: Specials = Specials(),
) -> Column:
    """No tests, enough documentation, not too long; the cheap tests come first.

    For rows of ``with_texts``. No token spans a line's end or the quotes around the
    documentation, so the complete function has the tokens of the documentation,
    which are counted once, and those of the rest.
    """
    sig, body = F.col("signature"), F.col("body")
    rest = t.complete_function(F.lit(""), sig, body, specials.bos, specials.eos)
    fits = F.exists(
        F.array(count_tokens(F.col("documentation"), specials)),
        lambda n: (n >= min_doc_tokens) & (n + count_tokens(rest, specials) <= max_tokens),
    )
    return ~p.has_testset(body) & ~p.names_test_function(sig) & fits


def prepare(functions: DataFrame, prompts: DataFrame, options: EncodeOptions = EncodeOptions()) -> DataFrame:
    """Decontaminate, deduplicate, clean the documentation, sample and gate.

    The order matters: copies go before the documentation filter, and the sample
    is drawn before the length gates.
    """
    rows = by_text(functions.where(p.outside_benchmark(F.col("project"))))
    rows = p.without_benchmark_names(rows.where(p.is_documented_basic()), prompts)
    doc = t.strip_signature(F.col("documentation"), F.col("signature"))
    rows = rows.withColumn("documentation", t.first_line(doc) if options.first_line else doc)
    if options.fraction < 1:
        # The sample reads its input three times, twice for the keys alone.
        rows = exact_sample(materialize(rows, "cleaned"), options.fraction, options.seed)
    return with_texts(rows, options.specials).where(
        is_encodable(p.MAX_TOKENS, options.min_doc_tokens, options.specials)
    )


#: Steps of the histogram between a count and its double.
COUNT_STEPS = 16


def vocabulary(texts: DataFrame, column: str, size: int, specials: Specials = Specials()) -> DataFrame:
    """``(token, n, id)``: the markers, then the ``size`` most frequent tokens.

    Tokens are counted per task before the shuffle, so a token that makes up a
    third of the corpus costs one row per task. A histogram of the counts'
    logarithms, some hundred rows, tells which tokens can be among the first, so
    about ``size`` rows are ranked, and not as many from each task.
    """
    counts = (
        texts.select(F.explode(tokens(F.col(column), specials)).alias("token"))
        .where(~F.col("token").isin(specials.ordered()))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counts = materialize(counts, "token-counts")
    step = F.floor(F.log2("n") * COUNT_STEPS)
    above = F.sum("tokens").over(Window.orderBy(F.desc("step"))) - F.col("tokens")
    histogram = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("tokens"))
    lowest = histogram.select("step", above.alias("above")).where(F.col("above") < size).agg(F.min("step")).scalar()
    order = [F.desc("n"), F.asc("token")]
    first = len(specials.ordered())
    ranked = counts.where(step >= lowest).orderBy(*order).limit(size).select(
        "token", "n", (F.row_number().over(Window.orderBy(*order)) + (first - 1)).cast("int").alias("id")
    )
    markers = F.array(
        *[
            F.struct(F.lit(s).alias("token"), F.lit(0).cast("bigint").alias("n"), F.lit(i).alias("id"))
            for i, s in enumerate(specials.ordered())
        ]
    )
    return texts.sparkSession.range(1).select(F.inline(markers)).unionByName(ranked)


#: Numbers the rows while they are encoded.
ROW = "__encode_row__"


def encode(rows: DataFrame, vocab: DataFrame, options: EncodeOptions = EncodeOptions()) -> DataFrame:
    """``rows`` with ``input_ids``, ``attention_mask`` and ``labels`` of fixed length.

    Rows get a number that is written with them, so equal keys stay apart. Tokens
    past ``max_length`` are cut before anything else: a row explodes into a bounded
    number of tokens. The vocabulary is joined in the way its size calls for.
    """
    sp, length = options.specials, options.max_length
    numbered = materialize(rows.withColumn(ROW, F.monotonically_increasing_id()), "numbered")

    def positions(side: str, column: str) -> Column:
        cut = F.slice(tokens(F.col(column), sp), 1, length)
        return F.transform(
            cut, lambda x, i: F.struct(F.lit(side).alias("side"), i.alias("pos"), x.alias("token"))
        )

    parts = F.concat(*[positions(s, c) for s, c in _sides(options)])
    known = (
        numbered.select(ROW, F.inline(parts))
        .join(vocab.select("token", "id"), "token", "left")
        .withColumn("id", F.coalesce("id", F.lit(sp.id_of(sp.unk))))
    )

    def collected(side: str) -> Column:
        return F.collect_list(F.when(F.col("side") == side, F.struct("pos", "id")))

    def ids(column: str) -> Column:
        found = F.transform(F.array_sort(column), lambda r: r["id"])
        return F.coalesce(found, F.array().cast("array<int>"))

    sides = [s for s, _ in _sides(options)]
    grouped = known.groupBy(ROW).agg(*[collected(s).alias(s) for s in sides])
    return (
        numbered.join(grouped, ROW, "left")
        .select(*rows.columns, *[ids(s).alias(s) for s in sides])
        .select(*rows.columns, *fixed_length(sides, length, sp.id_of(sp.eos)))
    )


def encode_prepared_rows(rows: DataFrame, options: EncodeOptions = EncodeOptions()) -> DataFrame:
    """Prepared rows, encoded with a vocabulary counted on them; they are written once, as both read them."""
    rows = materialize(rows, "prepared")
    words = vocabulary(rows, "complete_function", options.vocabulary_size, options.specials)
    return encode(rows, materialize(words, "vocabulary"), options)


def _sides(options: EncodeOptions) -> list[tuple[str, str]]:
    if options.simple_input:
        return [("x", "simple_input"), ("y", "simple_output")]
    return [("x", "complete_function")]


def fixed_length(sides: list[str], length: int, pad: int) -> list[Column]:
    """Cut and pad on the right; labels are padded too, and not masked."""

    def padded(c: Column) -> Column:
        cut = F.slice(c, 1, length)
        return F.concat(cut, F.array_repeat(F.lit(pad), length - F.size(cut)))

    x = F.col(sides[0])
    used = F.least(F.size(x), F.lit(length))
    mask = F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), length - used))
    return [
        padded(x).alias("input_ids"),
        mask.alias("attention_mask"),
        padded(F.col(sides[-1])).alias("labels"),
    ]
