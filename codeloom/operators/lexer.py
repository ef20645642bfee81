"""Strings, character literals and comments of a file, told from its code.

One alternation cuts a text into consecutive tokens: a stretch of code, a
comment, a string or a character. Each token is then rewritten on its own, so
the work is linear in the text, and all of it is expressions over one row.

Block comments nest up to ``DEPTH`` levels below the first. Code inside a string
may hold strings with code of their own and brackets up to five deep; beyond
these levels the first closing mark ends the token. A block comment or a
triple-quoted string that is never closed goes on to the end of the file, and
any other quote without a partner is code. Null stays null, and an empty text
stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks a line that starts inside a string or a block comment; in the code of a
#: file, ends a line after which a string goes on. A noncharacter, never in a text.
HIDDEN = "\ufdd2"
#: In a shortened text, stands for a run of lines inside a string or a block comment, with one ``MORE`` for each
#: line of the run but the first.
RUN, MORE = "\ufdd3", "\ufdd4"
#: Levels of comments inside a comment.
DEPTH = 6


def _block_comment(levels: int) -> str:
    inner = f"|{_block_comment(levels - 1)}" if levels else ""
    return rf"#=(?:[^#=]++{inner}|=(?!#)|#)*+(?:=#|\z)"


def _string(levels: int) -> str:
    """A string between single quotes; ``$( )`` in it holds code, with strings of its own."""
    return rf'"(?:[^"\\$]++|\\.{_code(levels)}|\$)*+"'


def _code(levels: int) -> str:
    if not levels:
        return ""
    return rf'|\$\((?:[^()"]++|{_string(levels - 1)}|{_brackets(4)})*+\)'


def _brackets(levels: int) -> str:
    inner = f"|{_brackets(levels - 1)}" if levels else ""
    return rf'\((?:[^()"]++|{_string(0)}{inner})*+\)'


TRIPLE = rf'"""(?:[^"\\$]++|\\.{_code(2)}|\$|"(?!""))*+(?:"""|\z)'
COMMENT = rf"{_block_comment(DEPTH)}|#[^\n]*+"
#: After a name, a bracket or another quote, a quote transposes and opens nothing.
CHARACTER = r"(?<![\p{L}\p{N}_)\]}'.])'(?:\\[^\n']++|\\'|[^'\\\n])'"
TOKEN = rf"""(?s)[^"'#]++|{COMMENT}|{TRIPLE}|{_string(2)}|{CHARACTER}|."""


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once; inside a fold nothing else shares it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _rewritten(content: Column, comment, string) -> Column:
    def token(t: Column) -> Column:
        first = F.substring(t, 1, 1)
        return (
            F.when(first == "#", comment(t))
            .when((F.length(t) > 1) & first.isin('"', "'"), string(t))
            .otherwise(t)
        )

    return F.array_join(F.transform(F.regexp_extract_all(content, F.lit(TOKEN), F.lit(0)), token), "")


def hide(content: Column) -> Column:
    """The text with a mark before each line that starts inside a string or a block comment."""

    def marked(t: Column) -> Column:
        return F.replace(t, F.lit("\n"), F.lit("\n" + HIDDEN))

    return _rewritten(content, marked, marked)


def code_of(content: Column) -> Column:
    """The text, line by line, with strings and characters as ``""`` and without comments."""

    def string(t: Column) -> Column:
        return F.concat(F.lit('""'), F.repeat(F.lit(HIDDEN + "\n"), F.length(t) - F.length(F.replace(t, F.lit("\n")))))

    return _rewritten(content, lambda t: F.regexp_replace(t, r"[^\n]++", ""), string)


def shortened(content: Column) -> Column:
    """``struct<text, code, runs>``: ``hide`` and ``code_of`` from one pass, without the lines that hold no code.

    Lines that lie inside a string or a block comment from end to end are taken out
    as a run, which is one line of ``text`` and of ``code``. The first such line of
    a comment is a run of its own, as an assignment ends there. ``restored`` puts
    the runs back.
    """
    none = F.expr("cast(array() as array<string>)")
    mark = "\n" + HIDDEN

    def of(text: Column, code: Column, runs: Column) -> Column:
        return F.struct(text.alias("text"), code.alias("code"), runs.alias("runs"))

    def run(lines: Column, start: int) -> Column:
        """The lines from a place, counted from 1, to the last but one."""
        return F.array_join(F.slice(lines, start, F.size(lines) - start), mark)

    def long(lines: Column, is_comment: Column) -> Column:
        n, first, last = F.size(lines), lines[0], F.get(lines, F.size(lines) - 1)
        two = is_comment & (n > 3)
        text = F.when(two, F.concat(first, F.lit(mark + RUN + mark + RUN), F.repeat(F.lit(MORE), n - 4), F.lit(mark), last))
        text = text.otherwise(F.concat(first, F.lit(mark + RUN), F.repeat(F.lit(MORE), n - 3), F.lit(mark), last))
        code = F.when(two, "\n\n\n").when(is_comment, "\n\n").otherwise(f'""{HIDDEN}\n{HIDDEN}\n')
        return of(text, code, F.when(two, F.array(lines[1], run(lines, 3))).otherwise(F.array(run(lines, 2))))

    def short(lines: Column, is_comment: Column) -> Column:
        two = F.size(lines) == 2
        code = F.when(is_comment, F.when(two, "\n").otherwise("")).otherwise(F.when(two, f'""{HIDDEN}\n').otherwise('""'))
        return of(F.array_join(lines, mark), code, none)

    def token(t: Column) -> Column:
        first = F.substring(t, 1, 1)
        is_comment = first == "#"
        opaque = is_comment | (first.isin('"', "'") & ~t.isin('"', "'"))

        def cut(lines: Column) -> Column:
            return F.when(F.size(lines) > 2, long(lines, is_comment)).otherwise(short(lines, is_comment))

        return F.when(opaque, let(F.split(t, "\n", -1), cut)).otherwise(of(t, t, none))

    def joined(tokens: Column) -> Column:
        text, code = (F.array_join(tokens[part], "") for part in ("text", "code"))
        return of(text, code, F.flatten(tokens["runs"]))

    return let(F.transform(F.regexp_extract_all(content, F.lit(TOKEN), F.lit(0)), token), joined)


def restored(text: Column, runs: Column, before: Column) -> Column:
    """A part of a shortened text with its lines put back, marked as by ``hide``; ``before`` it stand so many runs."""
    parts = F.split(text, f"{RUN}{MORE}*+", -1)

    def put(parts: Column) -> Column:
        own = F.slice(runs, before + 1, F.size(parts) - 1)
        return F.array_join(F.zip_with(parts, own, lambda p, run: F.concat(p, F.coalesce(run, F.lit("")))), "")

    return F.when(F.contains(text, F.lit(RUN)), let(parts, put)).otherwise(text)


def has_open_token(content: Column) -> Column:
    """A block comment or a triple-quoted string is never closed."""
    tokens = F.regexp_extract_all(content, F.lit(TOKEN), F.lit(0))
    last = F.get(tokens, F.size(tokens) - 1)
    balanced = F.regexp_count(last, F.lit("#=")) == F.regexp_count(last, F.lit("=#"))
    comment = F.startswith(last, F.lit("#=")) & ~(F.endswith(last, F.lit("=#")) & balanced)
    string = F.startswith(last, F.lit('"""')) & ~(F.endswith(last, F.lit('"""')) & (F.length(last) > 5))
    return F.coalesce(comment | string, F.lit(False))
