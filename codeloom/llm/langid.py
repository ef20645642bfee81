"""Language identification by compression.

For each language a raw-content dictionary is cut from labelled texts. A text is
reduced to its letters and compressed, block by block, once with each
dictionary; the language whose dictionary gives the fewest bytes wins. Blocks
keep long texts from becoming their own dictionary. Where the best two are close,
a stronger compression level measures them again. If they stay close the text is
rejected, and so is a text that even the best dictionary hardly makes smaller.

Texts that are null or have no letter get ``und``, a score of 0 and are
rejected. With one learned language all others get it. With none every text is
``und``. Ties go to the language with more labelled rows. Rows pass through one to one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import columns, map_rows, remainder, shared

#: Labelled texts for each language, the bound of the training sample, and the code points that they may have.
SAMPLE, SHORTEST, LONGEST = 200, 200, 4000
#: Bytes of a dictionary, and of a block.
DICTIONARY, BLOCK = 1 << 17, 1 << 12
#: Compression levels: for every text, and for those whose margin, a share of the second best size, is under CLOSE.
LEVEL, CLOSER_LEVEL, CLOSE = 3, 9, 0.08
#: A margin below this rejects. Of the training tables' texts 99% have more, of texts in a language that was not learned 5%.
MARGIN = 0.04
#: Bytes for each byte of letters, and for a text; more rejects, as in random letters.
CEILING, START = 0.57, 25
UNKNOWN = "und"

_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    return _OTHER.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def fit(docs: DataFrame, held_out: int = 0, of: int = 5) -> dict[str, bytes]:
    """A dictionary for each language, from at most ``SAMPLE`` texts each: those with the smallest hashes.

    Texts of ``SHORTEST`` to ``LONGEST`` code points are taken where a language
    has any, else all its texts that have a letter, of long ones the start.
    """
    rows = columns(docs, doc_id="doc_id", text="text", lang="lang").where(
        F.col("lang").isNotNull()
        & F.rlike("text", F.lit(r"\p{L}"))
        & (remainder(F.col("doc_id"), of) != held_out)
    )
    rows = rows.withColumn("usual", F.length("text").between(SHORTEST, LONGEST))
    counts = rows.groupBy("lang").agg(F.count_if("usual").alias("usual"), F.count(F.lit(1)).alias("all")).collect()
    frequent = {r["lang"]: r["usual"] or r["all"] for r in counts}
    unusual = [r["lang"] for r in counts if not r["usual"]]
    order = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "doc_id")
    sample = rows.where(F.col("usual") | F.col("lang").isin(unusual))
    sample = sample.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE)
    sample = sample.select("lang", "n", F.substring("text", 1, LONGEST).alias("text"))
    texts: dict[str, dict[str, None]] = {}
    for r in sorted(sample.collect(), key=lambda r: r["n"]):
        texts.setdefault(r["lang"], {})[r["text"]] = None
    return {lang: dictionary(list(texts[lang])) for lang in sorted(texts, key=lambda k: (-frequent[k], k))}


def dictionary(texts: list[str]) -> bytes:
    """At most ``DICTIONARY`` bytes, of every text as much: short texts whole, of the others the same share from the start."""
    parts = [letters(t) for t in texts]
    room, share = DICTIONARY - len(parts), 0
    for i, n in enumerate(sorted(map(len, parts))):
        share = room // (len(parts) - i)
        if n > share:
            break
        share, room = n, room - n
    return b" ".join(p[:share] for p in parts)


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages = list(dictionaries)
        self.compressors = {
            level: [_compressor(raw, level) for raw in dictionaries.values()] for level in (LEVEL, CLOSER_LEVEL)
        }

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, accepted."""
        shown = letters(text or "")
        if not shown or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        blocks = [shown[i : i + BLOCK] for i in range(0, len(shown), BLOCK)]
        ceiling = CEILING * len(shown) + START * len(blocks)
        for level in (LEVEL, CLOSER_LEVEL):
            sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.compressors[level]]
            best, *rest = sorted(sizes)
            margin = (rest[0] - best) / rest[0] if rest else 1.0
            if margin >= CLOSE and best <= ceiling:
                break
        return self.languages[sizes.index(best)], margin, margin >= MARGIN and best <= ceiling


def _compressor(raw: bytes, level: int) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(
        dict_data=d, level=level, write_content_size=False, write_checksum=False, write_dict_id=False
    )


def predict(docs: DataFrame, dictionaries: dict[str, bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, accepted``; the score is the share of bytes saved against the second best."""
    rows = columns(docs, doc_id=doc_id, text=text)
    held, kind = shared(docs, dictionaries), rows.schema["doc_id"].dataType.simpleString()

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        classify = Classifier(held.value)
        for d, t in it:
            yield d, *classify(t)

    return map_rows(rows, run, f"doc_id {kind}, lang_pred string, score double, accepted boolean")


def keep_accepted(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is accepted."""
    held = shared(docs, dictionaries)

    def accepted(it: Iterator) -> Iterator:
        import pyarrow as pa

        classify = Classifier(held.value)
        for batch in it:
            column = batch.column(batch.schema.get_field_index(text)).to_pylist()
            yield batch.filter(pa.array([classify(t)[2] for t in column], pa.bool_()))

    return docs.mapInArrow(accepted, docs.schema)
