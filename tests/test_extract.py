import pytest
from pyspark.sql import functions as F

from codeloom.operators.extract import extract_functions, has_unclosed_function, segments
from codeloom.operators.extract_syntax import extract_by_syntax


@pytest.fixture
def extract(spark):
    def run(source, **options):
        files = spark.createDataFrame([("a/p/src/x.jl", source)], "path string, content string")
        return extract_functions(files, **options).orderBy("line_number").collect()

    return run


def one(rows):
    assert len(rows) == 1
    return rows[0]


def test_first_end_closes(extract):
    source = "function f(x)\n if x\n 1\n end\n 2\nend\n"
    assert one(extract(source))["body"] == "if x\n 1"
    assert one(extract(source, end_rule="balanced"))["body"] == "if x\n 1\n end\n 2"


def test_return_type_gives_no_record(extract):
    assert extract("function f(x)::Int\n x\nend\n") == []


def test_one_line_docstring(extract):
    assert one(extract('"""doc"""\nfunction f(x)\n x\nend'))["documentation"] == "doc"


def test_long_docstring_wins_over_comments(extract):
    r = one(extract('# c\n"""\n  doc\n    more "x"\n"""\n# aside\n\nfunction f(x)\n x\nend'))
    assert r["documentation"] == 'doc\nmore "x"'
    assert r["line_number"] == 8


def test_comment_run(extract):
    assert one(extract("## a ##\n# b\n\nf(x) = 1"))["documentation"] == "a\nb"
    assert one(extract("# a\n\n# b\nf(x) = 1"))["documentation"] == "b"
    assert one(extract("# a\nusing X\nf(x) = 1"))["documentation"] == ""


def test_unclosed_docstring_hides_the_rest(extract):
    assert extract('"""\nfunction f(x)\n x\nend\n') == []


def test_single_line(extract):
    r = one(extract("f(x) = x + 1 # c"))
    assert (r["type"], r["signature"], r["body"]) == ("single-line", "f(x) =", "x + 1")
    assert r["inline_comments"] == ["c"]
    assert extract("f(x) == y") == []
    assert one(extract("f(x) =\n  x + 1\n"))["body"] == "x + 1"
    assert [r["type"] for r in extract("f(x) =\nfunction g(x)\n 1\nend")] == ["single-line", "basic"]


def test_anonymous(extract):
    r = one(extract("g = (a, b) -> a + b # c"))
    assert r["signature"] == "Anonymous Function assigned to g(a, b) ="
    assert (r["body"], r["inline_comments"], r["type"]) == ("a + b", ["c"], "anonymous")
    assert one(extract("# d\ng = (a) -> a"))["documentation"] == "d"
    assert one(extract("# d\n\ng = (a) -> a"))["documentation"] == ""


def test_begin_blocks(extract):
    r = one(extract("# d\nf(x) = begin y\n  z # c\n  end2\nend\n"))
    assert (r["signature"], r["body"]) == ("f(x) = begin", "begin\ny\n  z # c\n  end2\nend")
    assert (r["inline_comments"], r["line_number"], r["documentation"]) == (["c"], 2, "d")
    assert one(extract("f = (x) -> begin\n x\nend"))["signature"].endswith("f(x) = begin")
    assert one(extract("f(x) = beginning"))["body"] == "beginning"
    assert one(extract("f(x) = begin\n x\n"))["body"] == "begin\nx\nend"


def test_headers(extract):
    r = one(extract("\n\n  function push!(x,\n   y)  \n\n  x # é\nend # done\n"))
    assert (r["signature"], r["line_number"]) == ("function push!(x,\n   y)", 3)
    assert (r["body"], r["inline_comments"]) == ("x # é", ["# é"])
    assert extract("function f(x) x end") == []
    assert one(extract("function f()\nend"))["body"] == ""
    assert one(extract("function f(x)\n endx\nend"))["body"] == "endx"


def test_newlines(extract):
    assert one(extract("function f(x)\r\n  a\r\n  b\rend\r\n"))["body"] == "a\n  b"


def test_module(extract):
    rows = extract("f(x) = 1\nmodule A\ng(x) = 1\nbaremodule B\nh(x) = 1\n")
    assert [r["module"] for r in rows] == [None, "A", "B"]


def test_balanced(extract):
    source = (
        'function f(x)\n  """\n  if for end\n  """\n  y = x[end] # if\n  for i in [k for k in x if k > 0]\n'
        '    s = "if"\n  end\n  function inner(a)\n    a\n  end\n  g = :(end)\n  y\nend\nfunction h(x)\n  x\nend\n'
    )
    rows = extract(source, end_rule="balanced")
    assert [r["signature"] for r in rows] == ["function f(x)", "function h(x)"]
    assert rows[0]["body"].endswith("  g = :(end)\n  y")
    assert rows[1]["line_number"] == 15


def test_unclosed(spark):
    rows = [("function f(x)\n 1\nend\n", False), ("function f(x)\n 1\n", True), ("", False)]
    df = spark.createDataFrame(rows, "content string, expected boolean")
    for r in df.select("expected", has_unclosed_function(F.col("content")).alias("got")).collect():
        assert r["got"] is r["expected"]


def test_segments_cover_the_file(spark):
    texts = ["", "\n", "a", '"""', '"""x"""', "# c", "f(x) = 1\n\n\n# a", '"""\nf(x) = 1\n', "function f(x)\n 1"]
    df = spark.createDataFrame([(x,) for x in texts], "content string")
    for r in df.select("content", segments(F.col("content")).alias("s")).collect():
        assert "".join(r["s"]) == r["content"]


def test_large_file(extract):
    """Long comment runs, long bodies and headers without an end stay cheap."""
    source = "# c\n" * 3000 + "function f(x)\n" + "  a\n" * 3000 + "end\n" + "function g(x)\n" * 500
    assert one(extract(source))["line_number"] == 3001


def test_result_does_not_depend_on_partitions(spark, sf):
    from codeloom.plans.views import code_bundles

    files = code_bundles(spark, sf)
    few, many = (set(map(str, extract_functions(files.repartition(n)).collect())) for n in (1, 7))
    assert few == many and few


@pytest.fixture
def by_syntax(spark):
    def run(source):
        files = spark.createDataFrame([("a/p/src/x.jl", source)], "path string, content string")
        return extract_by_syntax(files).orderBy("line_number").collect()

    return run


def test_syntax_functions(by_syntax):
    source = (
        'module M\n"""doc"""\n  function f(x)::Int where T # h\n    if x\n      1 # c\n    end\n  end # f\n'
        "function g(x) x end\nfunction Base.show(io)\n  h(x) = 1\nend\nfunction test_f(x)\nend\n"
    )
    f, g = by_syntax(source)
    assert (f["signature"], f["documentation"], f["line_number"]) == ("function f(x)", '"""doc"""', 3)
    assert f["body"] == "if x\n1 # c\nend\nend"
    assert (f["inline_comments"], f["module"], f["type"]) == (["# h", "# c"], "M", "basic")
    assert (g["signature"], g["body"]) == ("function g(x)", "")


def test_syntax_assignments(by_syntax):
    source = (
        '"""doc"""\nf(x) = x + 1 # c\n"""lost"""\n# aside\nconst g = map(a -> a, b) # d\nh(x) = a -> x\n'
        "i(x) == 1\nj = 3\ntest(x) = 1\ntester = x -> 1\nk(x) = begin\n  x # e\nend\n"
    )
    f, g, h, tester, k = by_syntax(source)
    assert (f["signature"], f["body"], f["documentation"]) == ("f(x)", "x + 1", '"""doc"""')
    assert f["inline_comments"] == []
    assert (g["type"], g["signature"], g["body"]) == ("anonymous", "g = map(a -> a, b)", "a, b)")
    assert (h["type"], h["body"], h["documentation"]) == ("anonymous", "x", "")
    assert tester["signature"] == "tester = x -> 1"
    assert (k["body"], k["inline_comments"]) == ("begin\n  x # e\nend", ["# e"])


COMPREHENSION = "function f(x)\n y = [\n  i\n  for i in x\n ]\n y[end]\nend\n\nfunction g(x)\n if x\n  1\n end\n 2\nend\n"


def test_balanced_brackets_that_span_lines(extract):
    rows = extract(COMPREHENSION, end_rule="balanced")
    assert [(r["signature"], r["body"].split("\n")[-1].strip()) for r in rows] == [
        ("function f(x)", "y[end]"),
        ("function g(x)", "2"),
    ]


def test_balanced_do_block_in_a_call(extract):
    source = "function f(x)\n foo(\n  map(x) do i\n   i\n  end, 2)\n 3\nend\nfunction g(x)\n 1\nend\n"
    assert [r["body"].split("\n")[-1].strip() for r in extract(source, end_rule="balanced")] == ["3", "1"]


def test_balanced_keeps_what_follows_an_open_function(extract):
    source = "function f(x)\n if x\n  1\n 2\nend\nfunction g(x)\n 3\nend\n"
    rows = extract(source, end_rule="balanced")
    assert [r["signature"] for r in rows] == ["function f(x)", "function g(x)"]
    assert rows[1]["body"] == "3"


def test_module_ends(extract, by_syntax):
    source = (
        "module A\nf(x) = 1\nstruct S\n a\nend\nmodule B\nfunction g(x)\n if x\n  1\n end\nend\nend\n"
        'y = [\n i\n for i in z\n]\ns = "end"\nh(x) = z[end]\nend # A\nk(x) = 1\nend\nl(x) = 1\n'
    )
    wanted = [("f", "A"), ("g", "B"), ("h", "A"), ("k", None), ("l", None)]
    for rows in (extract(source), extract(source, end_rule="balanced"), by_syntax(source)):
        assert [(r["signature"].split("(")[0].split(" ")[-1], r["module"]) for r in rows] == wanted


def test_syntax_values_over_lines(by_syntax):
    source = (
        "a(x) = let y = x\n  y + 1\nend # c\nb(x) = if x\n  1\nelse\n  [k for k in x]\nend\n"
        "c(x) =\n  x + 1 # d\nd(x) = sum([\n  i\n  for i in x\n])\ne = map(x) do y -> 1\n  y\n end\nf(x) = x[end]\n"
    )
    rows = by_syntax(source)
    assert [(r["signature"], r["body"], r["line_number"]) for r in rows] == [
        ("a(x)", "let y = x\n  y + 1\nend", 1),
        ("b(x)", "if x\n  1\nelse\n  [k for k in x]\nend", 4),
        ("c(x)", "x + 1", 9),
        ("d(x)", "sum([\n  i\n  for i in x\n])", 11),
        ("e = map(x) do y -> 1", "1\n  y\n end", 15),
        ("f(x)", "x[end]", 18),
    ]


def test_syntax_value_that_nothing_closes(by_syntax):
    rows = by_syntax("a(x) = let y = x\n  y\nfunction b(x)\n  1\nend\nc(x) = 2\n")
    assert [r["signature"] for r in rows] == ["a(x)", "function b(x)", "c(x)"]
