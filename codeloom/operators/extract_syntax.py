"""The second extraction profile: records shaped by the syntax of a definition.

The same cut into segments as in ``extract``, with wider definitions and other
fields. Blocks end where they are balanced, any header after ``function`` opens
one, and every assignment is looked at, with all lines of its value. Documentation is a docstring only and
keeps its quotes; bodies are stripped line by line and keep their ``end``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as t
from codeloom.functions.text import HS, WS, hash_comments, path_part, split_comment, strip
from codeloom.operators.lexer import HIDDEN, let
from codeloom.operators.extract import (
    BLANKS,
    CONTINUED,
    DOC,
    END,
    EOL,
    INNER,
    OTHER,
    WORD_END,
    marked_definitions,
    newlines,
    without,
)

# Fixed values -----------------------------------------------------------------

#: What a signature looks like inside a definition.
CALL = r"[\p{L}\p{N}_]+\(.*?\)"
#: Separators between lines, as a string method would split them.
LINE_ENDS = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]"

# ------------------------------------------------------------------------------

LEAD = rf"(?>({DOC})({BLANKS}*+))?+"
FUNCTION = (
    rf"{HS}*+function{WORD_END}"
    rf"(?>[^\n]*[\s;)]end{HS}*+{EOL}|[^\n]*+\n(?:(?!{END})[^\n]*+\n)*+{END}[^\n]*+{EOL})"
)
TARGET = rf"[\p{{L}}_][\p{{L}}\p{{N}}_!.]*+(?:\{{[^\n}}]*+\}})?+(?:\([^\n]*?\))?(?:::[^\s=]++)?+(?:{HS}++where{HS}[^=\n]++)?+"
ASSIGNED = rf"{HS}*+(?:(?:const|global|local){HS}++)?+{TARGET}{HS}*+=(?![=>])"
ASSIGNMENT = rf"{ASSIGNED}[^\n]*+(?:\n{CONTINUED}[^\n]*+)*+{EOL}"
DOCUMENTED = rf"{LEAD}(?:{FUNCTION}|{ASSIGNMENT})"
SEGMENT = rf"(?>{DOCUMENTED})|{OTHER}"


def _plain_lines(c: Column) -> Column:
    return F.split(c, LINE_ENDS, -1)


def extract_by_syntax(files: DataFrame) -> DataFrame:
    """``files(path, content)`` to flat functions; tests are left out by their signatures."""
    content = t.unify_newlines(F.col("content").cast("string"))
    definitions = marked_definitions(content, f"^{ASSIGNED}", SEGMENT, DOCUMENTED)
    found = (
        files.select("path", F.explode(definitions).alias("d"))
        .select("path", "d.line", "d.module", without(F.col("d.text"), INNER, CONTINUED).alias("text"))
        .withColumn("lead", F.regexp_extract("text", f"^({LEAD})", 1))
        .withColumn("doc", without(F.regexp_extract("text", f"^{LEAD}", 1), HIDDEN))
    )
    raw = without(F.expr("substring(text, length(lead) + 1)"), HIDDEN)
    found = found.withColumn("raw", raw)
    is_function = F.rlike("raw", F.lit(rf"^{HS}*+function{WORD_END}"))

    # The text of the definition alone: no word before it, nothing after its end.
    function_text = F.regexp_replace(strip(F.col("raw")), rf"(?s)^(.*\n{HS}*+end){WORD_END}[^\n]*\z", "$1")
    # Nor a comment after the last line of a value.
    assigned = F.regexp_replace(strip(F.col("raw")), rf"^(?:const|global|local){HS}++", "")
    above = F.regexp_extract(assigned, rf"(?s)^(.*\n{HS}*+)", 1)
    last = F.substring(assigned, F.length(above) + 1, F.length(assigned))
    assignment_text = F.concat(above, split_comment(last)["code"])
    found = found.withColumn("code", F.when(is_function, function_text).otherwise(assignment_text))

    code = F.col("code")
    kind = (
        F.when(is_function, "basic")
        .when(F.contains(code, F.lit("->")), "anonymous")
        .when(F.rlike(code, F.lit(rf"(?d)^{CALL}{WS}*+=")), "single-line")
    )
    found = found.withColumn("kind", kind)

    is_basic, is_short = F.col("kind") == "basic", F.col("kind") == "single-line"
    signature = (
        F.when(is_basic, F.regexp_extract(code, rf"(?d)^function{WS}+{CALL}", 0))
        .when(is_short, F.regexp_extract(code, rf"(?d)^({CALL}){WS}*=", 1))
        .otherwise(strip(F.get(_plain_lines(code), F.lit(0))))
    )
    # As one item of an array: a filter on plain columns would take all texts apart once more, below.
    shaped = ["path", "line", "module", "lead", "doc", "code", "kind", signature.alias("signature")]
    found = found.select(F.inline(F.array(F.struct(*shaped)))).where("kind is not null and signature <> ''")

    # Lines that repeat the signature are no part of the body.
    lines = F.filter(
        let(_plain_lines(code), lambda all_: F.slice(all_, 2, F.size(all_))),
        lambda line: ~F.contains(line, F.col("signature")),
    )
    after_sign = F.when(is_short, F.expr("substring(code, locate('=', code) + 1)")).otherwise(
        F.expr("substring(code, locate('->', code) + 2)")
    )
    no_tests = (F.col("kind") == "anonymous") | ~F.contains(F.lower("signature"), F.lit("test"))
    return found.where(no_tests).select(
        path_part(F.col("path"), 0).alias("author"),
        path_part(F.col("path"), 1).alias("project"),
        F.when(F.col("kind") == "anonymous", "").otherwise(strip(F.col("doc"))).alias("documentation"),
        "signature",
        F.when(is_basic, F.array_join(F.transform(lines, strip), "\n"))
        .otherwise(strip(after_sign))
        .alias("body"),
        F.transform(hash_comments(code), strip).alias("inline_comments"),
        F.col("path").alias("file_path"),
        (F.col("line") + newlines(F.col("lead"))).cast("int").alias("line_number"),
        F.col("kind").alias("type"),
        "module",
    )
