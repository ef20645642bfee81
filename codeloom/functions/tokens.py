"""Tokens of a text: a regex tokenizer on the JVM."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -----------------------------------------------------------------

END_OF_TEXT = "<|endoftext|>"
UNKNOWN = "<|unk|>"
#: A word, or a single other character that is not white space.
SPACES = "\t\n\x0b\f\r "
WORD = "[A-Za-z0-9_]++"
OTHER = r"[^A-Za-z0-9_\t\n\x0b\f\r ]"

# ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Specials:
    """Marker tokens; padding uses the end marker."""

    bos: str = END_OF_TEXT
    eos: str = END_OF_TEXT
    unk: str = UNKNOWN

    def ordered(self) -> list[str]:
        return list(dict.fromkeys([self.eos, self.bos, self.unk]))

    def id_of(self, token: str) -> int:
        return self.ordered().index(token)


def token_pattern(specials: Specials = Specials()) -> str:
    """Markers count as one token each; words, the usual case, are tried first if they can be."""
    markers = [re.escape(s) for s in specials.ordered()]
    if any(re.match("[A-Za-z0-9_]", s) for s in specials.ordered()):
        return "|".join([*markers, WORD, OTHER])
    return "|".join([WORD, *markers, OTHER])


def tokens(c: Column, specials: Specials = Specials()) -> Column:
    return F.regexp_extract_all(c, F.lit(token_pattern(specials)), F.lit(0))


def count_tokens(c: Column, specials: Specials = Specials()) -> Column:
    """Each token with the space before it becomes one character: no array of tokens is built."""
    marks = F.regexp_replace(F.rtrim(c, F.lit(SPACES)), rf"[{SPACES}]*+(?:{token_pattern(specials)})", "x")
    return F.length(marks)


def ngrams(token_array: Column, n: int) -> Column:
    """All runs of ``n`` tokens, joined by spaces.

    Items are picked by position; a slice per n-gram would copy the array each time.
    """

    def gram(first: Column, i: Column) -> Column:
        return F.concat_ws(" ", first, *[F.get(token_array, i + j) for j in range(1, n)])

    return F.transform(F.slice(token_array, F.lit(1), F.greatest(F.size(token_array) - n + 1, F.lit(0))), gram)
