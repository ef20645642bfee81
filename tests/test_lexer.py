import pytest
from pyspark.sql import functions as F

from codeloom.operators.extract import extract_functions
from codeloom.operators.extract_syntax import extract_by_syntax
from codeloom.plans.jobs import build_corpus
from codeloom.operators.lexer import HIDDEN, TOKEN, code_of, has_open_token, hide, restored, shortened

CASES = [
    ("", ""),
    ("x = 1 # end", "x = 1 "),
    ('x = "a # b" # c\ny', 'x = ""\ny'.replace("\n", " \n")),
    ("a #= b #= c =# d =# e", "a  e"),
    ("a #= b\n#= c\n=# d\n=# e", "a \n\n\n e"),
    ('s = """a " b\n"" end""" + 1', f's = ""{HIDDEN}\n + 1'),
    ('s = "a $(f("b", (1, "c"))) # d" + 1', 's = "" + 1'),
    ('s = "$x \\" end" * t', 's = "" * t'),
    ("c = '\"'; d = '#'; e = '\\''; f = '\\u2203'", 'c = ""; d = ""; e = ""; f = ""'),
    ("b = a' * c'; d = x.y'", "b = a' * c'; d = x.y'"),
    ('odd " quote # end\nend', 'odd " quote \nend'),
    ("a #= never\nend", "a \n"),
    ('a = """never\nend', f'a = ""{HIDDEN}\n'),
]


def test_code_of(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)] + [(99, None)], "i int, a string")
    rows = df.select("i", "a", code_of(F.col("a")).alias("c"), hide(F.col("a")).alias("h"), F.regexp_extract_all("a", F.lit(TOKEN), F.lit(0)).alias("t"))
    for r in rows.orderBy("i").collect():
        if r.a is None:
            assert r.c is None and r.h is None
            continue
        assert r.c == CASES[r.i][1], r.a
        assert "".join(r.t) == r.a and r.h.replace(HIDDEN, "") == r.a and r.c.count("\n") == r.a.count("\n")


def test_open_tokens(spark):
    cases = [("a #= b", True), ("a #= b =#", False), ("#= #= =#", True), ('"""a', True), ('"""a"""', False), ("", False), ("# a", False), ("a\n", False)]
    df = spark.createDataFrame(cases, "a string, wanted boolean")
    for r in df.select("a", "wanted", has_open_token(F.col("a")).alias("got")).collect():
        assert r.got == r.wanted, r.a


def test_open_files_are_rejects(spark, tmp_path):
    files = [("a/b/src/%s.jl" % n, c) for n, c in (("s", 'f(x) = 1\n"""\ng(x) = 2\n'), ("c", "#= f(x) = 1\n"), ("u", "function f(x)\n"))]
    files += [("a/b/src/ok.jl", 's = """\nfunction f(x)\n"""\nf(x) = 1\n')]
    df = spark.createDataFrame(files, "path string, content string").withColumn("content", F.col("content").cast("binary"))
    out, bad = str(tmp_path / "f"), str(tmp_path / "r")
    assert [r.file_path for r in build_corpus(df, out, profile="syntax", rejects=bad).collect()] == ["a/b/src/ok.jl"]
    why = {r.path[8:-3]: r.reason for r in spark.read.parquet(bad).collect()}
    assert why == {"s": "unclosed string or comment", "c": "unclosed string or comment", "u": "unclosed function"}


def test_long_tokens(spark):
    body = "#= " + "x = # y \n" * 200_000 + "=#\nf(x) = 1\n" + 's = """' + 'a "b" $(c) \\n\n' * 100_000 + '"""\ng(x) = 2\n'
    df = spark.createDataFrame([("a/b/c.jl", body)], "path string, content string")
    assert df.select(F.length(code_of(F.col("content"))).alias("n")).first().n < len(body)


SOURCE = '''\
s = """
function lost(x)
  1
end
"""
"""
About f: if "this" then that.
"""
function f(x)
  y = "end"
  t = """
  end
  # no comment
  """
  if x == '"' # why
    y = x[end]
  end
  y
end
#= module Z
function hidden(x)
  1
end
#= deeper =#
=#
module A
g(x) = x + 1
end
function h(x)
  "a $(join(["b", "end"])) for"
end
'''


@pytest.mark.parametrize("way", ["balanced", "syntax"])
def test_strings_and_comments_hide_nothing_else(spark, way):
    files = spark.createDataFrame([("a/b/c.jl", SOURCE)], "path string, content string")
    df = extract_by_syntax(files) if way == "syntax" else extract_functions(files, "balanced")
    rows = {r.signature.removesuffix(" ="): r for r in df.collect()}
    assert set(rows) == {"function f(x)", "g(x)", "function h(x)"}
    f, g, h = rows["function f(x)"], rows["g(x)"], rows["function h(x)"]
    assert "About f" in f.documentation and '"this" then that.' in f.documentation
    assert f.line_number == 9 and "y = x[end]" in f.body and f.body.rstrip("end\n ").endswith("y")
    assert (f.module, g.module, h.module) == (None, "A", None)
    assert 'join(["b", "end"])' in h.body
    for r in rows.values():
        assert not any(0xFDD0 <= ord(c) <= 0xFDEF for v in r if isinstance(v, str) for c in v)
        assert not any(0xFDD0 <= ord(c) <= 0xFDEF for v in r.inline_comments for c in v)


def test_values_go_on_after_an_operator(spark):
    source = 'h(x) = x +\n  2\nk(x) = x * # more\n  y &&\n  z\nm(x) = """a\nb""" * x\ns(x) = :+\nn(x) = 1\n'
    files = spark.createDataFrame([("a/b/c.jl", source)], "path string, content string")
    rows = {r.signature: r.body for r in extract_by_syntax(files).collect()}
    assert rows["h(x)"] == "x +\n  2"
    assert rows["k(x)"].startswith("x *") and rows["k(x)"].endswith("z")
    assert rows["m(x)"] == '"""a\nb""" * x'
    assert rows["s(x)"] == ":+" and rows["n(x)"] == "1"


def test_lines_without_code_are_taken_out_and_put_back(spark):
    long = "\n".join(f"{i} end # no" for i in range(500))
    texts = [a for a, _ in CASES] + ['s = """\n%s\n  """ + 1\nf(x) = 1\n' % long, "#= a\n%s\n=# x" % long, "#= a\nb\nc =# end"]
    texts += ["x = 1 +\n#= a\nb =#\n2", 'show("a\nb\nc") # d\n"""\n"""']
    df = spark.createDataFrame([(a,) for a in texts], "a string").withColumn("s", shortened(F.col("a")))
    rows = df.select("a", "s.*", hide(F.col("a")).alias("h"), restored(F.col("s.text"), F.col("s.runs"), F.lit(0)).alias("back"), code_of(F.col("a")).alias("c"))
    for r in rows.collect():
        assert r.back == r.h and r.text.count("\n") == r.code.count("\n") <= min(r.a.count("\n"), 5), r.a
        # Lines with code are the same, in the same order.
        assert [x for x in r.code.replace(HIDDEN, "").split("\n") if x] == [x for x in r.c.replace(HIDDEN, "").split("\n") if x]


def test_definitions_keep_their_lines_around_long_texts(spark):
    text = "end\n" * 300
    content = f's = """\n{text}"""\nmodule M\n#=\n{text}=#\nfunction f(x)\n  t = """\n{text}"""\n  if x\n    1\n  end\nend\nend\ng(x) = x +\n#= a\nb\n=# 2\n'
    df = spark.createDataFrame([("a/b/c.jl", content)], "path string, content string")
    head = content[: content.index("function f")].count("\n") + 1
    for ends, found in ((301, extract_functions(df, end_rule="balanced")), (302, extract_by_syntax(df))):
        got = {r.signature: r for r in found.collect()}
        f = got["function f(x)"]
        assert (f.line_number, f.module, f.body.count("end")) == (head, "M", ends)
    assert got["g(x)"].line_number == content[: content.index("g(x)")].count("\n") + 1
