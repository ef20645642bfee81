"""Function extraction: one row per file in, one row per function out.

A file is cut into segments by one alternation that matches from line to line:
a definition with the documentation before it, a docstring, a run of comments,
a run of blank lines, or any other line. Segments never overlap, so consumed
lines cannot yield a second record. The cut and everything after it are
expressions over a single row; the job is a narrow scan without a shuffle, and
its unit of parallelism is the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as t
from codeloom.functions.text import HS, WS, bare_comments, hash_comments, path_part, split_comment, strip
from codeloom.operators.lexer import HIDDEN, MORE, RUN, code_of, let, restored, shortened

# Fixed values -----------------------------------------------------------------

#: A function or variable name: ASCII letter or ``_`` first, then also marks.
NAME = r"[A-Za-z_][\p{L}\p{N}_!?@#$%^&*+\-]*+"

#: Words that open a block which ``end`` closes.
BLOCK_WORDS = [
    "function", "if", "for", "while", "begin", "let", "try", "do", "module", "baremodule", "struct",
    "macro", "quote", "abstract type", "primitive type",
]

ANONYMOUS_PREFIX = "Anonymous Function assigned to "

# Building blocks --------------------------------------------------------------

EOL = r"(?:\n|\z)"
WORD_END = r"(?![\p{L}\p{N}_])"
END = rf"{HS}*+end{WORD_END}"
PARAMS = r"\(([^)]*+)\)"

#: A docstring that closes on its own line.
SHORT_DOC = rf'{HS}*+"""[^\n]*?"""[^\n]*+{EOL}'
#: A docstring up to the next line that ends in quotes, or to the end of the file.
LONG_DOC = rf'{HS}*+"""[^\n]*+\n(?:(?![^\n]*"""{HS}*+{EOL})[^\n]*+\n)*+[^\n]*+{EOL}'
#: A docstring whose further lines are marked.
MARKED_DOC = rf'{HS}*+"""[^\n]*+\n(?:{HIDDEN}[^\n]*+{EOL})++'
DOC = rf"(?>{SHORT_DOC}|{MARKED_DOC}|{LONG_DOC})"
COMMENTS = rf"(?:{HS}*+#[^\n]*+\n)++"
BLANKS = rf"(?:{HS}*+\n)"
BLANKS_OR_COMMENTS = rf"(?:{HS}*+(?:#[^\n]*+)?\n)"

#: Documentation before a definition: 1 docstring and 2 the lines after it, or
#: 3 comment run and 4 the blank lines after it.
LEAD = rf"(?>({DOC})({BLANKS_OR_COMMENTS}*+)|({COMMENTS})({BLANKS}*+))?+"

BASIC_HEAD = rf"{HS}*+function{WS}++({NAME}){WS}*+{PARAMS}{HS}*+\n"
BASIC_BODY = rf"((?:(?!{END})[^\n]*+\n)*+)"
SHORT_HEAD = rf"{HS}*+({NAME}){WS}*+{PARAMS}{WS}*+=(?!=)"
LAMBDA_HEAD = rf"{HS}*+({NAME}){HS}*+={HS}*+\(([^)\n]*+)\){HS}*+->"
#: ``begin``, the rest of its line, lines up to one that is just ``end``.
BEGIN = (
    rf"begin{WORD_END}([^\n]*+)"
    rf"((?:\n(?!{HS}*+end{HS}*+{EOL})[^\n]*+)*+)(?:\n{HS}*+end{HS}*+)?+{EOL}"
)
#: The expression may start on the next line.
VALUE = rf'(?>{HS}*+\n{WS}*+(?!function{WORD_END}|#|""")[^\n]++|[^\n]*+){EOL}'

BASIC = BASIC_HEAD + BASIC_BODY + END
SHORT_BEGIN = rf"{SHORT_HEAD}{WS}*+{BEGIN}"
LAMBDA_BEGIN = rf"{LAMBDA_HEAD}{HS}*+{BEGIN}"

DEFINITION = (
    rf"(?:{BASIC}[^\n]*+{EOL}|{SHORT_BEGIN}|{SHORT_HEAD}{VALUE}|{LAMBDA_BEGIN}|{LAMBDA_HEAD}[^\n]*+{EOL})"
)
#: Lines that start inside a string or a comment go with the line that opens it.
REST = rf"(?:{HIDDEN}[^\n]*+{EOL})"
OTHER = rf"{DOC}|{REST}++|(?:{HS}*+#[^\n]*+{EOL}{REST}*+)++|{BLANKS}++|[^\n]*+\n{REST}*+|[^\n]++\z"

DOCUMENTED = rf"{LEAD}{DEFINITION}"
SEGMENT = rf"(?>{DOCUMENTED})|{OTHER}"

MODULE = rf"^{HS}*+(?:bare)?module{WS}++([\p{{L}}\p{{N}}_!]++)"
OPEN_HEAD = rf"^{BASIC_HEAD}\z"

#: Marks an ``end`` that closes an inner block; a noncharacter, never in a text.
INNER = "\ufdd0"
#: Marks a line that belongs to the assignment above it.
CONTINUED = "\ufdd1"
#: The value goes on in the next line: a string does, or an operator stands at the end that is no symbol.
GOES_ON = rf"{HIDDEN}\z|(?<!:)(?:[-+*/\\^%&|<>=~?:,÷]|\b(?:in|isa|where))[\t ]*+\z"

# ------------------------------------------------------------------------------


def newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n")))


def without(c: Column, *marks: str) -> Column:
    for mark in marks:
        c = F.replace(c, F.lit(mark), F.lit(""))
    return c


def segments(content: Column, pattern: str = SEGMENT) -> Column:
    """A file as an array of consecutive segments."""
    return F.regexp_extract_all(content, F.lit(pattern), F.lit(0))


FOUND = "cast(array() as array<struct<line: int, run: int, module: string, text: string>>)"


def marked_definitions(
    content: Column, assignment: str | None = None, segment: str = SEGMENT, definition: str = DOCUMENTED
) -> Column:
    """``definitions`` of a text after ``mask_inner_ends``; lines without code are put back into what is found alone."""

    def whole(marked: Column) -> Column:
        def put_back(d: Column) -> Column:
            text = restored(d["text"], marked["runs"], d["run"])
            return F.struct(d["line"].alias("line"), d["module"].alias("module"), text.alias("text"))

        modular = F.exists(marked["code"], lambda line: F.rlike(line, F.lit(MODULE)))
        found = definitions(marked["text"], modular, segment, definition, marked["code"])
        return F.transform(found, put_back)

    return let(shortened(content), lambda short: let(_masked(short, assignment), whole))


def definitions(
    content: Column, modular: Column, segment: str = SEGMENT, definition: str = DOCUMENTED, code: Column | None = None
) -> Column:
    """``array<struct<line, run, module, text>>`` of the segments that define a function.

    One pass carries the line number along and, in files that are ``modular``, a
    stack of open blocks: a module's name, or null for any other block. The
    innermost name is the module of a definition; its ``end`` takes it from the
    stack.

    With the array of the lines' ``code``, the text is a shortened one, and ``run``
    counts the runs before a definition. Otherwise each segment is looked at for its code.
    """

    def marks(s: Column, mark: str) -> Column:
        return F.length(s) - F.length(F.replace(s, F.lit(mark)))

    def code_in(acc: Column, s: Column) -> Column:
        return code_of(s) if code is None else F.array_join(F.slice(code, acc["at"] + 1, newlines(s)), "\n")

    def place(acc: Column, s: Column) -> list[Column]:
        if code is None:
            return [(acc["line"] + newlines(s)).cast("int").alias("line"), acc["at"].alias("at"), acc["run"].alias("run")]
        return [
            (acc["line"] + newlines(s) + marks(s, MORE)).cast("int").alias("line"),
            (acc["at"] + newlines(s)).cast("int").alias("at"),
            (acc["run"] + marks(s, RUN)).cast("int").alias("run"),
        ]

    def defines(s: Column) -> Column:
        return F.rlike(s, F.lit("^" + definition))

    def found(acc: Column, s: Column, module: Column, is_definition: Column) -> list[Column]:
        record = F.struct(acc["line"].alias("line"), acc["run"].alias("run"), module.alias("module"), s.alias("text"))
        return [
            *place(acc, s),
            F.when(is_definition, F.array_append(acc["found"], record)).otherwise(acc["found"]).alias("found"),
        ]

    def plain(acc: Column, s: Column) -> Column:
        return F.struct(*found(acc, s, F.lit(None).cast("string"), defines(s)))

    def stacked(acc: Column, s: Column) -> Column:
        blocks, names = acc["blocks"], F.array_compact(acc["blocks"])

        def counted(is_definition: Column) -> Column:
            silent = ~is_definition & F.rlike(s, F.lit(rf'^(?:{HS}*+(?:#(?!=)|""")|{HIDDEN})'))
            unchanged = F.struct(acc["brackets"].alias("brackets"), F.lit(0).alias("depth"))
            change = F.when(silent, unchanged).otherwise(let(code_in(acc, s), lambda code: _counted(code, acc["brackets"])))
            return F.struct(change.alias("change"), is_definition.alias("defines"))

        def moved(seen: Column) -> Column:
            depth = seen["change"]["depth"]
            name = F.nullif(F.regexp_extract(s, MODULE, 1), F.lit(""))
            opened = F.concat(F.array(name), F.array_repeat(F.lit(None).cast("string"), depth - 1))
            left = F.slice(blocks, 1, F.greatest(F.size(blocks) + depth, F.lit(0)))
            return F.struct(
                *found(acc, s, F.get(names, F.size(names) - 1), seen["defines"]),
                seen["change"]["brackets"].alias("brackets"),
                F.when(depth > 0, F.concat(blocks, opened)).when(depth < 0, left).otherwise(blocks).alias("blocks"),
            )

        return let(let(defines(s), counted), moved)

    parts = segments(content, segment)
    start = [F.lit(1).alias("line"), F.lit(0).alias("at"), F.lit(0).alias("run"), F.expr(FOUND).alias("found")]
    stack = [F.lit(0).alias("brackets"), F.expr("cast(array() as array<string>)").alias("blocks")]
    return F.when(modular, F.aggregate(parts, F.struct(*start, *stack), stacked, lambda acc: acc["found"])).otherwise(
        F.aggregate(parts, F.struct(*start), plain, lambda acc: acc["found"])
    )


def names_module(content: Column) -> Column:
    return F.rlike(content, F.lit(f"(?m){MODULE}"))


def has_unclosed_function(content: Column) -> Column:
    """A function header without a closing ``end``."""
    return F.exists(segments(t.unify_newlines(content)), lambda s: F.rlike(s, F.lit(OPEN_HEAD)))


#: Words that open a block, as a pattern.
OPENERS = "|".join(w.replace(" ", r"\s+") for w in BLOCK_WORDS)


def _bare(code: Column) -> Column:
    """Code without strings, comments, and brackets that close in it."""
    code = F.regexp_replace(code, r'"(?:[^"\\]|\\.)*+"|#.*', " ")

    def closed(c: Column) -> Column:
        for _ in range(3):
            c = F.regexp_replace(c, r"\[[^\[\]()]*+\]|\([^\[\]()]*+\)", " ")
        return c

    return let(code, lambda c: F.when(F.rlike(c, F.lit(r"[\])]")), closed(c)).otherwise(c))


def _change(code: Column, brackets: Column, after: Column) -> Column:
    """Openers less ends, without what stands in brackets that span lines."""
    code = F.regexp_replace(code, rf"[:.](?:end|{OPENERS})\b", " ")
    code = F.when(brackets > 0, F.regexp_replace(code, r"^.*[\])]", " ")).otherwise(code)
    code = F.when(after > 0, F.regexp_replace(code, r"[\[(].*$", " ")).otherwise(code)

    def count(c: Column) -> Column:
        return F.regexp_count(c, F.lit(rf"\b(?:{OPENERS})\b")) - F.regexp_count(c, F.lit(r"\bend\b"))

    return F.when((brackets > 0) & (after > 0), 0).otherwise(let(code, count))


def _counted(code: Column, brackets: Column) -> Column:
    """Brackets open after a line or segment, and the change of depth; most lines need no closer look."""

    def looked(bare: Column) -> Column:
        net = F.regexp_count(bare, F.lit(r"[\[(]")) - F.regexp_count(bare, F.lit(r"[\])]"))
        return let(
            F.greatest(brackets + net, F.lit(0)).cast("int"),
            lambda after: F.struct(
                after.alias("brackets"), _change(bare, brackets, after).cast("int").alias("depth")
            ),
        )

    plain = F.struct(brackets.cast("int").alias("brackets"), F.lit(0).alias("depth"))
    marks = F.rlike(code, F.lit(rf"\b(?:end|{OPENERS})\b|[\[\]()]"))
    return F.when(marks, let(_bare(code), looked)).otherwise(plain)


def mask_inner_ends(content: Column, assignment: str | None = None) -> Column:
    """The text with marks, see ``_masked``."""
    masked = let(shortened(content), lambda short: _masked(short, assignment))
    return let(masked, lambda m: restored(m["text"], m["runs"], F.lit(0)))


def _masked(short: Column, assignment: str | None = None) -> Column:
    """Mark every ``end`` inside a function that does not close the function.

    A running block depth decides: openers count up, ``end`` counts down, in the
    code alone, without strings, characters and comments, and without brackets,
    also those that span lines, as ``a[end]`` or a comprehension closes nothing.
    Lines that start inside a string or a block comment are marked as ``HIDDEN``:
    nothing starts or ends there. After this the first unmarked
    ``end`` is the right one. If a header in the first column shows that a
    function was not closed, its last ``end`` closes it, so no file is lost.

    ``assignment`` is the pattern of a line outside functions whose value may go
    on: while its blocks, brackets or a string are open, or after an operator, the
    next lines are marked as ``CONTINUED``. Such a header ends an assignment as well.

    Takes what ``shortened`` gives; ``struct<text, code, runs>`` with the lines' code as an array.
    """

    def reopened(out: Column) -> Column:
        """The last marked ``end`` without its mark: nothing else closed its function."""
        last = F.array_max(F.transform(out, lambda x, i: F.when(x == INNER, i)))
        return F.transform(out, lambda x, i: F.when(i == last, "").otherwise(x))

    start = F.struct(
        F.lit(0).alias("depth"),
        F.lit(0).alias("brackets"),
        F.lit(-1).alias("function_depth"),
        F.lit(-1).alias("assigned_depth"),
        F.expr("cast(array() as array<string>)").alias("out"),
    )

    def step(acc: Column, both: Column) -> Column:
        line, code = both["line"], both["code"]
        open_function, open_value = acc["function_depth"] >= 0, acc["assigned_depth"] >= 0
        hidden = F.startswith(line, F.lit(HIDDEN))
        # A header in the first column while something is open: that was never closed.
        broken = (open_function | open_value) & F.rlike(line, F.lit(r"^function\b"))
        outermost = F.when(open_function, acc["function_depth"]).otherwise(acc["assigned_depth"])
        before = F.when(broken, outermost).otherwise(acc["depth"])
        is_head = (broken | ~(open_function | open_value)) & F.rlike(line, F.lit(rf"^{HS}*+function\b"))
        is_value = F.lit(False)
        if assignment is not None:
            is_value = ~hidden & ~open_function & ~open_value & (acc["brackets"] == 0) & F.rlike(line, F.lit(assignment))
        def looked(seen: Column) -> Column:
            return F.struct(
                seen["brackets"].alias("brackets"),
                (before + seen["depth"]).cast("int").alias("depth"),
                F.when(is_head, before).otherwise(acc["function_depth"]).cast("int").alias("outer"),
                F.when(is_value, before)
                .otherwise(F.when(broken, -1).otherwise(acc["assigned_depth"]))
                .cast("int")
                .alias("assigned"),
                broken.alias("broken"),
            )

        def moved(now: Column) -> Column:
            depth, outer, assigned = now["depth"], now["outer"], now["assigned"]
            closes = (outer >= 0) & (depth <= outer)
            inner = (outer >= 0) & ~closes & F.rlike(line, F.lit(rf"^{END}"))
            goes_on = (assigned >= 0) & ((depth > assigned) | (now["brackets"] > 0) | F.rlike(code, F.lit(GOES_ON)))
            mark = F.when(inner, INNER).when(open_value & (assigned >= 0), CONTINUED).otherwise("")
            out = F.when(now["broken"] & open_function, reopened(acc["out"])).otherwise(acc["out"])
            return F.struct(
                depth.alias("depth"),
                now["brackets"].alias("brackets"),
                F.when(closes, -1).otherwise(outer).alias("function_depth"),
                F.when(goes_on, assigned).otherwise(-1).alias("assigned_depth"),
                F.array_append(out, mark).alias("out"),
            )

        seen = let(_counted(code, F.when(broken, 0).otherwise(acc["brackets"])), looked)
        return let(seen, moved)

    def marked(lines: Column) -> Column:
        marks = F.aggregate(F.arrays_zip(lines["line"].alias("line"), lines["code"].alias("code")), start, step, lambda acc: acc["out"])
        text = F.array_join(F.zip_with(marks, lines["line"], lambda mark, line: F.concat(mark, line)), "\n")
        return F.struct(text.alias("text"), lines["code"].alias("code"), short["runs"].alias("runs"))

    return let(F.struct(t.lines(short["text"]).alias("line"), t.lines(short["code"]).alias("code")), marked)


def _documentation(text: Column, kind: Column) -> Column:
    doc = F.replace(F.regexp_extract(text, f"^{LEAD}", 1), F.lit(HIDDEN), F.lit(""))
    run = F.regexp_extract(text, f"^{LEAD}", 3)
    between = F.concat(F.regexp_extract(text, f"^{LEAD}", 2), F.regexp_extract(text, f"^{LEAD}", 4))
    short = F.regexp_extract(doc, rf'^{HS}*+"""([^\n]*?)"""', 1)
    long = F.btrim(strip(F.array_join(F.transform(t.lines(doc), strip), "\n")), F.lit('"'))
    docstring = strip(F.when(F.rlike(doc, F.lit(f"^{SHORT_DOC}")), short).otherwise(long))
    comments = F.transform(
        t.lines(F.rtrim(run, F.lit("\n"))), lambda line: strip(F.btrim(strip(line), F.lit("#")))
    )
    # A lambda takes its documentation from the line right above only.
    detached = (kind == "anonymous") & F.rlike(between, F.lit(rf"(?m)^{HS}*+\n"))
    return (
        F.when(detached, "")
        .when(doc != "", docstring)
        .when(run != "", F.array_join(comments, "\n"))
        .otherwise("")
    )


def _block(rest: Column, inner: Column) -> Column:
    return F.concat(F.lit("begin\n"), strip(F.concat(strip(rest), inner)), F.lit("\nend"))


def extract_functions(files: DataFrame, end_rule: str = "first") -> DataFrame:
    """``files(path, content)`` to flat functions.

    ``end_rule="first"`` closes a function at the first line that starts with
    ``end``; ``"balanced"`` at the ``end`` that matches its header.

    Kinds: ``basic`` (``function f(x) ... end``), ``single-line`` (``f(x) = ...``)
    and ``anonymous`` (``f = (x) -> ...``); the last two also with a
    ``begin ... end`` block. Documentation is the docstring before the header,
    else the run of comments before it; blank lines may stand between.
    """
    content = t.unify_newlines(F.col("content").cast("string"))
    if end_rule == "balanced":
        found = marked_definitions(content)
    elif end_rule == "first":
        found = definitions(content, names_module(F.col("content").cast("string")))
    else:
        raise ValueError(f"unknown end rule: {end_rule}")

    def unmarked(c: Column) -> Column:
        return without(c, INNER, HIDDEN) if end_rule == "balanced" else c

    found = files.select("path", F.explode(found).alias("d")).select(
        "path",
        F.col("d.line").alias("line"),
        F.col("d.module").alias("module"),
        F.col("d.text").alias("text"),
    )
    lead = F.regexp_extract("text", f"^({LEAD})", 1)
    found = found.withColumn("lead", lead).withColumn("code", F.expr("substring(text, length(lead) + 1)"))

    code = F.col("code")
    kind = (
        F.when(F.rlike(code, F.lit(f"^{BASIC_HEAD}")), "basic")
        .when(F.rlike(code, F.lit(f"^{SHORT_BEGIN}")), "single-line block")
        .when(F.rlike(code, F.lit(f"^{SHORT_HEAD}")), "single-line")
        .when(F.rlike(code, F.lit(f"^{LAMBDA_BEGIN}")), "anonymous block")
        .otherwise("anonymous")
    )
    found = found.withColumn("kind", kind)

    is_basic = F.col("kind") == "basic"
    is_short = F.startswith("kind", F.lit("single-line"))
    is_block = F.endswith("kind", F.lit("block"))

    def part(i: int) -> Column:
        text = (
            F.when(is_basic, F.regexp_extract(code, f"^{BASIC}", i))
            .when(is_short & is_block, F.regexp_extract(code, f"^{SHORT_BEGIN}", i))
            .when(is_short, F.regexp_extract(code, rf"^{SHORT_HEAD}{WS}*+([^\n]*+)", i))
            .when(is_block, F.regexp_extract(code, f"^{LAMBDA_BEGIN}", i))
            .otherwise(F.regexp_extract(code, rf"^{LAMBDA_HEAD}{HS}*+([^\n]*+)", i))
        )
        return unmarked(text)

    inner = F.when(is_short, F.regexp_extract(code, f"^{SHORT_BEGIN}", 4)).otherwise(
        F.regexp_extract(code, f"^{LAMBDA_BEGIN}", 4)
    )
    found = found.select(
        "*",
        part(1).alias("name"),
        strip(part(2)).alias("params"),
        part(3).alias("value"),
        F.when(is_block, unmarked(inner)).alias("inner"),
    )

    one_line = split_comment(F.col("value"))
    kind = F.regexp_replace("kind", " block", "")
    call = F.concat("name", F.lit("("), "params", F.lit(")"))
    signature = (
        F.when(is_basic, F.concat(F.lit("function "), call))
        .when(is_short, F.concat(call, F.lit(" =")))
        .otherwise(F.concat(F.lit(ANONYMOUS_PREFIX), call, F.lit(" =")))
    )
    return found.select(
        path_part(F.col("path"), 0).alias("author"),
        path_part(F.col("path"), 1).alias("project"),
        _documentation(F.col("text"), kind).alias("documentation"),
        F.concat(signature, F.when(is_block, " begin").otherwise("")).alias("signature"),
        F.when(is_basic, strip(F.col("value")))
        .when(is_block, _block(F.col("value"), F.col("inner")))
        .otherwise(one_line["code"])
        .alias("body"),
        F.when(is_basic, hash_comments(strip(F.col("value"))))
        .when(is_block, bare_comments(F.col("inner")))
        .otherwise(one_line["comments"])
        .alias("inline_comments"),
        F.col("path").alias("file_path"),
        (F.col("line") + newlines(F.col("lead"))).cast("int").alias("line_number"),
        kind.alias("type"),
        "module",
    )
