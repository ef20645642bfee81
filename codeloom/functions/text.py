"""Text rules for source code and documentation, as Column -> Column functions.

All of them are built from JVM expressions, so they stay in the scan stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -----------------------------------------------------------------

#: Every character that counts as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
#: The same characters as a regex class, and the class without the newline.
WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
HS = r"[\t\x0b\f\r\x1c-\x1f\x85\p{Z}]"

#: Marks of a worked example in a docstring.
EXAMPLE_MARKS = ["# Example", "```jldoctest", "```julia-repl"]

#: Reserved words of the language.
KEYWORDS = [
    "baremodule", "begin", "break", "catch", "const", "continue", "do", "else", "elseif", "end",
    "export", "false", "finally", "for", "function", "global", "if", "import", "let", "local",
    "macro", "module", "quote", "return", "struct", "true", "try", "using", "while",
]

MIN_COMMENT_LETTERS = 3

# ------------------------------------------------------------------------------


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def unify_newlines(c: Column) -> Column:
    """CRLF and CR become LF."""
    return F.when(F.contains(c, F.lit("\r")), F.regexp_replace(c, r"\r\n?", "\n")).otherwise(c)


def count_lines(c: Column) -> Column:
    """Lines of a text, however they end; a trailing line end opens no further line."""

    def count(mark: str) -> Column:
        return (F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))) / len(mark)

    closed = F.endswith(c, F.lit("\n")) | F.endswith(c, F.lit("\r")) | (c == "")
    ends = count("\n") + count("\r") - count("\r\n")
    return (ends + F.when(closed, 0).otherwise(1)).cast("int")


def is_comment(line: Column) -> Column:
    return F.startswith(strip(line), F.lit("#"))


def drop_empty_comments(body: Column) -> Column:
    """Drop whole-line comments with fewer than three ASCII letters."""

    def keep(line: Column) -> Column:
        letters = F.length(F.regexp_replace(line, "[^a-zA-Z]", ""))
        return ~is_comment(line) | (letters >= MIN_COMMENT_LETTERS)

    return F.array_join(F.filter(lines(body), keep), "\n")


def code_lines(body: Column) -> Column:
    """The stripped lines that hold code: neither blank nor whole-line comments."""
    stripped = F.transform(lines(body), strip)
    return F.filter(stripped, lambda s: (s != "") & ~F.startswith(s, F.lit("#")))


def normalize_body(body: Column) -> Column:
    return F.array_join(code_lines(body), "\n")


def count_code_lines(body: Column) -> Column:
    return F.size(code_lines(body))


def is_annotated(signature: Column) -> Column:
    return F.contains(signature, F.lit("::"))


def _group(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def plain_name(signature: Column) -> Column:
    """Name of letters, digits and ``_`` at the start; ``push!`` has none."""
    return _group(signature, rf"^function{WS}+([a-zA-Z_][a-zA-Z0-9_]*)\(")


def searched_name(text: Column) -> Column:
    """Whatever stands between the first ``function `` and its parenthesis."""
    return _group(text, r"function ([^(]+)\(")


def leading_name(signature: Column) -> Column:
    """Whatever stands between a leading ``function`` and the parenthesis."""
    return _group(signature, rf"^function{WS}+([^(]+)")


def has_good_doc(documentation: Column, signature: Column) -> Column:
    """Starts with the function's name, or shows an example."""
    doc, name = strip(documentation), plain_name(strip(signature))
    example = F.lit(False)
    for mark in EXAMPLE_MARKS:
        example = example | F.contains(doc, F.lit(mark))
    return F.coalesce((doc != "") & name.isNotNull() & (F.startswith(doc, name) | example), F.lit(False))


def strip_signature(documentation: Column, signature: Column) -> Column:
    """Drop repeated leading ``name(...)`` calls from a docstring, then outer newlines.

    The name is a column, so the pattern is one too. A signature without a
    leading name leaves the docstring as it is.
    """
    quoted = F.concat(
        F.lit("\\Q"), F.replace(leading_name(signature), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")
    )
    calls = F.concat(F.lit(rf"(?s)^(?:(?:function )?{WS}*"), quoted, F.lit(rf"{WS}*\(.*?\){WS}*)++"))
    return F.coalesce(F.btrim(F.regexp_replace(documentation, calls, F.lit("")), F.lit("\n")), documentation)


def first_line(documentation: Column) -> Column:
    """Up to the first full stop or empty line, whichever comes first."""
    stop = F.least(
        F.nullif(F.locate(".", documentation), F.lit(0)), F.nullif(F.locate("\n\n", documentation), F.lit(0))
    )
    return F.coalesce(F.substring(documentation, F.lit(1), stop), documentation)


def wrap_doc(documentation: Column, strip_rules: bool = False) -> Column:
    """Quote a docstring; ``strip_rules`` also drops runs of three or more dashes."""
    doc = F.regexp_replace(documentation, "---+", "") if strip_rules else documentation
    return F.concat(F.lit('"""'), doc, F.lit('\n"""'))


def prompt_name(prompt: Column) -> Column:
    """Name of the function a benchmark prompt asks for, docstrings left out."""
    return searched_name(F.regexp_replace(prompt, r'(?s)""".*?"""', ""))


def model_input(documentation: Column, signature: Column, bos: str) -> Column:
    return F.concat(F.lit(bos), documentation, F.lit("\n"), signature, F.lit("\n"))


def complete_function(documentation: Column, signature: Column, body: Column, bos: str, eos: str) -> Column:
    return F.concat(model_input(documentation, signature, bos), model_output(body, eos))


def model_output(body: Column, eos: str) -> Column:
    return F.concat(body, F.lit("\nend" + eos))


def split_comment(line: Column) -> Column:
    """``struct(code, comments)`` of a line cut at every ``#``."""
    parts = F.transform(F.split(line, "#", -1), strip)
    return F.struct(parts[0].alias("code"), F.slice(parts, F.lit(2), F.size(parts)).alias("comments"))


def hash_comments(text: Column) -> Column:
    """Everything from the first ``#`` of a line on, marks kept."""
    return F.regexp_extract_all(text, F.lit("(?d)#.*"), F.lit(0))


def bare_comments(text: Column) -> Column:
    """As ``hash_comments``, without the mark and stripped."""
    return F.transform(F.regexp_extract_all(text, F.lit("(?d)#(.*)"), F.lit(1)), strip)


def problem_number(name: Column) -> Column:
    return F.regexp_extract(name, "([0-9]+)", 1).try_cast("bigint")


def prediction(program: Column, prompt: Column, tests: Column) -> Column:
    """What a model wrote: the program without the prompt before and the tests after it."""
    size = F.length(program) - F.length(prompt) - F.length(tests)
    return F.substring(program, F.length(prompt) + 1, F.greatest(size, F.lit(0)))


def scrub_keywords(text: Column, keywords: list[str] = KEYWORDS) -> Column:
    """Drop reserved words and special characters and collapse white space."""
    word = r"[\p{L}\p{N}_]"
    words = F.regexp_replace(text, rf"(?<!{word})(?:{'|'.join(keywords)})(?!{word})", " ")
    return F.btrim(F.regexp_replace(words, r"[^A-Za-z0-9_]+", " "))


def rebuild(signature: Column, body: Column) -> Column:
    return F.concat_ws("\n", signature, body, F.lit("end"))


def path_part(path: Column, i: int) -> Column:
    return F.get(F.split(path, "/", -1), F.lit(i))


def text_hash(*columns: Column) -> Column:
    """A 256-bit hash of one or more texts; lengths keep the borders apart."""
    parts = []
    for c in columns:
        parts += [F.coalesce(F.length(c).cast("string"), F.lit("n")), F.lit(":"), F.coalesce(c, F.lit(""))]
    return F.unhex(F.sha2(F.concat(*parts), 256))
