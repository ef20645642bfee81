import pytest
from pyspark.sql import functions as F

from codeloom.functions import text as t
from codeloom.functions.tokens import Specials, count_tokens, ngrams, tokens
from codeloom.operators import filters as p

L = F.lit


@pytest.mark.parametrize(
    "body, expected",
    [("# --\n# abc\nx = 1 # --", "# abc\nx = 1 # --"), ("a\n  #é1\nb\n", "a\nb\n"), ("", "")],
)
def test_drop_empty_comments(value, body, expected):
    assert value(t.drop_empty_comments(L(body))) == expected


def test_normalize_and_count(value):
    assert value(t.normalize_body(L("  a\n\n# note\n\tb "))) == "a\nb"
    assert value(t.normalize_body(L("　a\xa0\n \x1c\n"))) == "a"
    assert value(t.count_code_lines(L("a\n\n# c\n  b"))) == 2
    assert value(t.count_code_lines(L(""))) == 0


@pytest.mark.parametrize(
    "text, n",
    [("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("a\r\nb\r\n", 2), ("a\rb", 2), ("a\r", 1), ("\n\n", 2)],
)
def test_count_lines(value, text, n):
    assert value(t.count_lines(L(text))) == n


def test_long_file_limit(value):
    assert value(p.fits_line_limit(L("x\n" * 10_000)))
    assert not value(p.fits_line_limit(L("x\n" * 10_000 + "x")))


def test_names(value):
    assert value(t.plain_name(L("function push!(x)"))) is None
    assert value(t.plain_name(L("function f_1(x)"))) == "f_1"
    assert value(t.searched_name(L("a function g!(x)"))) == "g!"
    assert value(t.leading_name(L("function  push!(x)"))) == "push!"
    assert value(t.leading_name(L(" function push!(x)"))) is None
    assert value(t.prompt_name(L('"""\nfunction no(x)\n"""\nfunction yes(x)'))) == "yes"
    assert value(t.prompt_name(L('"""only a doc"""'))) is None


@pytest.mark.parametrize(
    "doc, good",
    [("foobar", True), ("Adds.", False), ("Adds.\n# Example", True), ("", False), ("a ```jldoctest", True)],
)
def test_good_doc(value, doc, good):
    assert value(t.has_good_doc(L(doc), L(" function foo(x)"))) is good
    assert value(t.has_good_doc(L(doc), L("foo(x) ="))) is False


@pytest.mark.parametrize(
    "doc, name, expected",
    [
        ("push!(a,b)\npush!(a)\nAdds x", "push!", "Adds x"),
        ("function f(x) f(\ny)  \n\nDoc\n", "f", "Doc"),
        ("f without call", "f", "f without call"),
        ("a.b(1)x", "a.b", "x"),
        ("aXb(1)x", "a.b", "aXb(1)x"),
        ("\\E(1)x", "\\E", "x"),
    ],
)
def test_strip_signature(value, doc, name, expected):
    assert value(t.strip_signature(L(doc), L(f"function {name}(x)"))) == expected


def test_strip_signature_many_calls(value):
    assert value(t.strip_signature(L("f(x)\n" * 20_000 + "doc"), L("function f(x)"))) == "doc"


def test_strip_signature_without_name(value):
    assert value(t.strip_signature(L("\ndoc\n"), L("  function f(x)"))) == "\ndoc\n"


@pytest.mark.parametrize(
    "doc, expected",
    [("One. Two", "One."), ("a\n\nb", "a\n"), ("none", "none"), ("a\n\nb.", "a\n"), (".", "."), ("", "")],
)
def test_first_line(value, doc, expected):
    assert value(t.first_line(L(doc))) == expected


def test_wrap_and_assemble(value):
    assert value(t.wrap_doc(L("d"))) == '"""d\n"""'
    assert value(t.wrap_doc(L("a-----b--"), strip_rules=True)) == '"""ab--\n"""'
    assert value(t.complete_function(L("D"), L("S"), L("B"), "<", ">")) == "<D\nS\nB\nend>"
    assert value(t.rebuild(L("S"), L("B"))) == "S\nB\nend"


def test_comments(value):
    split = value(t.split_comment(L("x + 1 # c # d")))
    assert (split["code"], split["comments"]) == ("x + 1", ["c", "d"])
    assert value(t.split_comment(L("x")))["comments"] == []
    assert value(t.hash_comments(L("a # b # c\nd\u0085 # e\u0085f"))) == ["# b # c", "# e\u0085f"]
    assert value(t.bare_comments(L("a # b "))) == ["b"]


def test_results(value):
    assert value(t.prediction(L("PbodyT"), L("P"), L("T"))) == "body"
    assert value(t.prediction(L("Pbody"), L("P"), L(""))) == "body"
    assert value(t.prediction(L("P"), L("PP"), L("T"))) == ""
    assert value(t.problem_number(L("HumanEval_10_x"))) == 10
    assert value(t.problem_number(L("none"))) is None


def test_scrub(value):
    assert value(t.scrub_keywords(L("if x == endx\n  é_end end; y!"))) == "x endx _end y"


def test_paths(value):
    kept = {
        "a/p/src/x.jl": True,
        "a/p/.git/x.jl": False,
        "a/p/src/.git/x.jl": True,
        "a/p/.github/w/x.jl": False,
        "a/p/x.py": False,
    }
    for path, expected in kept.items():
        assert value(p.is_kept_source(L(path))) is expected, path
    assert not value(p.is_project_source(L("a/p/TESTS/x.jl")))
    assert not value(p.is_project_source(L("a/x.jl")))
    assert value(p.is_project_source(L("a/p/x.jl")))


def test_tokens(value):
    assert value(tokens(L("f(x_1) <|endoftext|>é"))) == ["f", "(", "x_1", ")", "<|endoftext|>", "é"]
    assert value(count_tokens(L("START a", ), Specials(bos="START", eos="STOP"))) == 2
    assert value(count_tokens(L(" \n"))) == 0
    abc = F.array(L("a"), L("b"), L("c"))
    assert value(ngrams(abc, 1)) == ["a", "b", "c"]
    assert value(ngrams(abc, 2)) == ["a b", "b c"]
    assert value(ngrams(abc, 4)) == []
