import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from codeloom.operators import filters as p
from codeloom.operators.encode import EncodeOptions
from codeloom.operators.evaluate import in_problem_order, result_rows
from codeloom.operators.extract import extract_functions
from codeloom.plans import jobs, views
from codeloom.sources import archives, readers, writers
from codeloom.sources.storage import in_batches
from codeloom.streaming import ingest
from codeloom.streaming.ingest import ingest_available

SOURCES = {
    "dev1/A.jl/src/a.jl": b'"""doc"""\nfunction f(x::Int)\n  x\nend\n',
    "dev1/A.jl/test/t.jl": b"function test_f(x)\n  x\nend\n",
    "dev1/A.jl/.git/h.jl": b"g(x) = 1\n",
    "dev2/B c.jl/b+c%20.jl": "h(x) = 'é' # ü\n".encode(),
    "dev2/B c.jl/bad.jl": b"k(x) = 1 \xff\n",
    "dev2/B c.jl/_hidden/.x/_y.jl": b"# no function\n",
    "dev2/B c.jl/readme.md": b"f(x) = 1\n",
}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "repos"
    for path, content in SOURCES.items():
        file = root / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(content)
    return str(root)


def test_repositories(spark, tmp_path):
    path = tmp_path / "list.csv.gz"
    path.write_bytes(gzip.compress(b'stars,name,description\n1,a/b,"x\ny"\n2,c/d,"q""q"\n'))
    assert [r["name"] for r in readers.read_repositories(spark, str(path)).collect()] == ["a/b", "c/d"]


def test_source_tree(spark, tree):
    files = {r["path"]: bytes(r["content"]) for r in readers.read_source_tree(spark, tree).collect()}
    assert files == {k: v for k, v in SOURCES.items() if k.endswith(".jl")}


def test_files_beyond_a_row_are_reported(spark, tree, monkeypatch):
    monkeypatch.setattr(readers, "MAX_FILE_BYTES", 30)
    kept = {r["path"] for r in readers.read_source_tree(spark, tree).collect()}
    left = {tuple(r) for r in readers.read_oversized(spark, tree).collect()}
    assert left == {(k, "too large") for k, v in SOURCES.items() if len(v) > 30 and k.endswith(".jl")}
    assert not kept & {path for path, _ in left}


def test_archives(spark, tmp_path):
    names = []
    for i, (path, content) in enumerate(SOURCES.items()):
        name = str(tmp_path / f"{i % 2}.zip")
        with zipfile.ZipFile(name, "a", zipfile.ZIP_DEFLATED) as z:
            z.writestr(path, content)
        names.append(name)
    got = archives.read_archives(spark, sorted(set(names)), p.is_project_source(F.col("path")))
    assert {r["path"]: bytes(r["content"]) for r in got.collect()} == {
        k: v for k, v in SOURCES.items() if k.endswith(".jl") and "test" not in k
    }


def test_members_are_read_in_place(spark, tmp_path, monkeypatch):
    name, content = str(tmp_path / "many.zip"), {f"a/p/f{i}.jl": b"x = %d\n" % i * (i + 1) for i in range(50)}
    methods = [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA]
    with zipfile.ZipFile(name, "w") as z:
        for i, (path, data) in enumerate(content.items()):
            z.writestr(path, data, methods[i % 4])
        z.writestr("a/p/empty.jl", b"")
    got = archives.read_archives(spark, [name])
    assert {r["path"]: bytes(r["content"]) for r in got.collect()} == {**content, "a/p/empty.jl": b""}

    # Within a range the archive is opened once, and its directory is not read.
    members = archives.list_members(spark, [name]).toPandas()
    opened, real = [], archives._open
    monkeypatch.setattr(archives, "_open", lambda uri: opened.append(uri) or real(uri))
    monkeypatch.setattr(zipfile, "ZipFile", None)
    frames = list(archives._read(iter([members[:20], members[20:]])))
    assert opened == [name] and sum(map(len, frames)) == len(frames[0]) == 51


def test_batches_of_files():
    files = [(str(i), b"x" * n) for i, n in enumerate([3, 4, 20, 1, 0, 9])]
    frames = list(in_batches(files, 10))
    assert [f["path"].tolist() for f in frames] == [["0", "1"], ["2"], ["3", "4", "5"]]
    assert list(in_batches([])) == []


def test_corpus_job_records_files_that_no_row_holds(spark, tree, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "MAX_FILE_BYTES", 30)
    out, left = str(tmp_path / "functions"), str(tmp_path / "rejects")
    files = readers.read_source_tree(spark, tree)
    jobs.build_corpus(files, out, rejects=left, unread=readers.read_oversized(spark, tree))
    found = {r["path"] for r in spark.read.parquet(left).where("reason = 'too large'").collect()}
    assert found == {r["path"] for r in readers.read_oversized(spark, tree).collect()} and found


def test_rejects(spark, tree):
    files = readers.read_source_tree(spark, tree)
    assert [tuple(r) for r in writers.rejects(files).collect()] == [("dev2/B c.jl/bad.jl", "not utf-8")]
    assert {r["reason"] for r in writers.rejects(files, limit=2).collect()} == {"not utf-8", "too many lines"}


def test_corpus_job_and_curation(spark, tree, tmp_path):
    files = readers.read_source_tree(spark, tree)
    functions = jobs.build_corpus(files, str(tmp_path / "functions"))
    assert {r["signature"] for r in functions.collect()} == {"function f(x::Int)", "function test_f(x)", "h(x) ="}
    assert {r["author"] for r in functions.collect()} == {"dev1", "dev2"}
    counters = jobs.curate_corpus(functions, str(tmp_path / "curated")).first()
    assert (counters["total_functions"], counters["kept"], counters["bad_doc"]) == (3, 1, 1)
    assert writers.read_curated(spark, str(tmp_path / "curated"), "bad").count() == 1
    assert (tmp_path / "curated" / "doc_quality=bad").is_dir()
    report = jobs.corpus_report(functions)
    assert tuple(report["totals"].first()) == (2, 2, 3)
    first = jobs.build_corpus(files, str(tmp_path / "first"), first_authors=1)
    assert {r["author"] for r in first.collect()} == {"dev1"}


def test_corpus_job_accounts_for_every_file(spark, tmp_path):
    content = {
        "a/p/empty.jl": b"x = 1\n",
        "b/p/f.jl": b"function f(x)\n 1\nend\n",
        "b/p/open.jl": b"function g(x)\n 1\n",
        "b/p/bad.jl": b"\xff",
        "c/p/h.jl": b"function h(x)\n 1\nend\n",
    }
    rows = [(k, bytearray(v)) for k, v in content.items()]
    files = spark.createDataFrame(rows, "path string, content binary")
    for profile, skipped in (("text", {"b/p/bad.jl"}), ("syntax", {"b/p/bad.jl", "b/p/open.jl"})):
        out, left = str(tmp_path / profile), str(tmp_path / f"{profile}-rejects")
        functions = jobs.build_corpus(files, out, first_authors=2, profile=profile, rejects=left)
        assert {r["path"] for r in spark.read.parquet(left).collect()} == skipped
        # The author whose files have no function counts too.
        assert {r["author"] for r in functions.collect()} == {"b"}


def test_project_json_round_trip(spark, sf, tmp_path):
    functions = extract_functions(views.code_bundles(spark, sf))
    writers.write_projects(functions, str(tmp_path / "json"), as_json=True)
    writers.write_projects(functions, str(tmp_path / "p.parquet"))
    lines = [json.loads(x) for f in (tmp_path / "json").glob("*.json") for x in f.read_text("utf-8").splitlines()]
    array = tmp_path / "array.json"
    array.write_text(json.dumps(lines), encoding="utf-8")
    expected = sorted(map(str, functions.select("author", "project", "signature", "body", "line_number").collect()))
    for path, lines_ in ((array, False), (tmp_path / "json", True), (tmp_path / "p.parquet", False)):
        back = jobs.functions_of(readers.read_projects(spark, str(path), lines_))
        rows = back.select("author", "project", "signature", "body", "line_number").collect()
        assert sorted(map(str, rows)) == expected


def test_malformed_json_fails(spark, tmp_path):
    path = tmp_path / "prompts.jsonl"
    path.write_text('{"prompt": "a", "x": 1}\n{"prompt": \n')
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        readers.read_prompts(spark, str(path)).collect()
    path.write_text('{"prompt": "a", "x": 1}\n')
    assert [tuple(r) for r in readers.read_prompts(spark, str(path)).collect()] == [("a",)]


def test_results_to_p_value(spark, tmp_path):
    for run, statuses in (("a", ["OK", "OK", "Timeout"]), ("b", ["OK", "Exception", "OK"])):
        for i, status in enumerate(statuses):
            folder = tmp_path / run / str(i)
            folder.mkdir(parents=True)
            doc = {
                "name": f"HumanEval_{i * 10}_x", "prompt": "P", "tests": "T", "extra": 1,
                "results": [{"program": f"Pbody{i}T", "status": status}, {"program": "P", "status": "OK"}],
            }
            (folder / f"{i}.results.json.gz").write_bytes(gzip.compress(json.dumps(doc).encode()))
            (folder / "other.json").write_text("{}")
        rows = jobs.export_results(spark, str(tmp_path / run), str(tmp_path / f"{run}.json"))
        assert [r["problem"] for r in in_problem_order(rows).collect()] == [f"HumanEval_{i}0_x".replace("_00_", "_0_") for i in range(3)]
        assert {r["prediction"] for r in rows.collect()} == {"body0", "body1", "body2"}
    row = jobs.compare_runs(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json")).first()
    assert tuple(row) == (1, 1, 1, 0, 1.0)
    array = tmp_path / "array.json"
    for text, lines in (('[{"problem": "p", "passed": true}, {"problem": "q"}]', True), ('[\n{"problem":\n"p"}, {}]', False)):
        array.write_text(text)
        assert readers.read_results(spark, str(array), lines).count() == 2


def test_result_without_programs(spark):
    df = spark.createDataFrame(
        [("n1", "p", "t", [])], "name string, prompt string, tests string, results array<struct<program: string, status: string>>"
    )
    r = result_rows(df).first()
    assert (r["prediction"], r["passed"]) == (None, False)


def test_cleaned_files_table(spark, tree, tmp_path):
    writers.write_files(readers.read_source_tree(spark, tree), str(tmp_path / "files"))
    assert spark.read.parquet(str(tmp_path / "files")).count() == 5


def test_encoded_tables_are_reused(spark, sf, tmp_path):
    functions, prompts = views.code_functions(spark, sf), views.prompts(spark, sf)
    root, options = str(tmp_path / "encoded"), EncodeOptions(max_length=64, vocabulary_size=200)
    first = jobs.encode_corpus(functions, prompts, root, options=options)
    assert first.count() > 0 and first.columns[-3:] == ["input_ids", "attention_mask", "labels"]
    (folder,) = (tmp_path / "encoded" / "words").iterdir()
    before = folder.stat().st_mtime_ns, sorted(x.name for x in folder.iterdir())
    again = jobs.encode_corpus(functions, prompts, root, options=options)
    assert (folder.stat().st_mtime_ns, sorted(x.name for x in folder.iterdir())) == before
    assert again.count() == first.count()
    assert readers.read_encoded(spark, str(folder)).count() == first.count()
    jobs.encode_corpus(functions, prompts, root, options=options, force=True)
    assert sorted(x.name for x in folder.iterdir()) != before[1]
    jobs.encode_corpus(functions.where("author = 'dev1'"), prompts, root, options=options)
    assert len(list((tmp_path / "encoded" / "words").iterdir())) == 2


def test_ingest_resumes(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("files", "out", "state"))

    def add(n):
        rows = [(f"dev/P.jl/f{n}_{i}.jl", bytearray(b"function f(x)\n 1\nend\n")) for i in range(3)]
        bad = [(f"dev/P.jl/bad{n}.jl", bytearray(b"f(x) = \xff"))]
        spark.createDataFrame(rows + bad, "path string, content binary").write.mode("append").parquet(source)

    add(1)
    assert ingest_available(spark, source, target, checkpoint) == 1
    assert spark.read.parquet(target).count() == 3
    assert ingest_available(spark, source, target, checkpoint) == 0
    assert spark.read.parquet(target).count() == 3
    add(2)
    ingest_available(spark, source, target, checkpoint)
    assert sorted(r["file_path"][-6:-3] for r in spark.read.parquet(target).collect()) == [
        f"{n}_{i}" for n in (1, 2) for i in range(3)
    ]


def test_zipped_projects(spark, tmp_path):
    """Zipped JSON gives the rows of the plain files, from arrays and from single records."""
    function = {"signature": "f(x) =", "documentation": "d \u00e9", "body": "x", "inline_comments": ["a", "b"], "line_number": 3}
    records = [{"author": f"dev{i}", "project": "P.jl", "functions": [function] * i} for i in range(4)]
    plain = tmp_path / "plain"
    plain.mkdir()
    (plain / "a.json").write_text(json.dumps(records[:3], indent=1))
    (plain / "b.json").write_text(json.dumps(records[3]))
    for name in ("one.zip", "two.zip"):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z:
            z.write(plain / ("a.json" if name == "one.zip" else "b.json"), "data/combined.json")
            z.writestr("notes.txt", "no json")
    zipped = archives.read_zipped_projects(spark, [str(tmp_path / "one.zip"), str(tmp_path / "two.zip")])
    wanted = readers.read_projects(spark, str(plain))
    assert zipped.columns == wanted.columns and wanted.count() == 4
    assert sorted(map(repr, zipped.collect())) == sorted(map(repr, wanted.collect()))
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("a.json", "[{")
    with pytest.raises(Exception):
        archives.read_zipped_projects(spark, [str(tmp_path / "bad.zip")]).collect()


def test_ingest_records_what_it_skips(spark, tmp_path, monkeypatch):
    """A run that breaks between the two writes is done again; each file is in one of the tables, once."""
    source, target, checkpoint, left = (str(tmp_path / x) for x in ("files", "out", "state", "left"))
    good = [(f"dev/P.jl/f{i}.jl", bytearray(b"function f(x)\n 1\nend\n")) for i in range(3)]
    bad = [("dev/P.jl/bad.jl", bytearray(b"f(x) = \xff")), ("dev/P.jl/long.jl", bytearray(b"\n" * 10_001))]
    other = [("dev/P.jl/readme.md", bytearray(b"\xff")), ("dev/P.jl/.git/x.jl", bytearray(b"\xff"))]
    spark.createDataFrame(good + bad + other, "path string, content binary").write.parquet(source)
    real, calls = ingest.write_batch, []

    def breaks(rows, folder, batch):
        calls.append(folder)
        if len(calls) == 2:
            raise OSError("lost between both writes")
        real(rows, folder, batch)

    monkeypatch.setattr(ingest, "write_batch", breaks)
    with pytest.raises(Exception):
        ingest_available(spark, source, target, checkpoint, rejects=left)
    assert calls == [target, left] and spark.read.parquet(target).count() == 3
    assert ingest_available(spark, source, target, checkpoint, rejects=left) == 1
    assert ingest_available(spark, source, target, checkpoint, rejects=left) == 0
    functions, skipped = spark.read.parquet(target), spark.read.parquet(left)
    assert sorted(r.file_path for r in functions.collect()) == [path for path, _ in good]
    assert sorted((r.path, r.reason) for r in skipped.collect()) == [
        ("dev/P.jl/bad.jl", "not utf-8"),
        ("dev/P.jl/long.jl", "too many lines"),
    ]


def test_syntax_job_leaves_tests_and_loose_files_out(spark, tmp_path):
    paths = ["dev/P.jl/a.jl", "dev/P.jl/Test/b.jl", "dev/P.jl/src/mytests.jl", "dev/c.jl", "dev/P.jl/.github/d.jl"]
    rows = [(path, bytearray(b"function f(x)\n 1\nend\n")) for path in paths]
    rows += [("dev/P.jl/test/bad.jl", bytearray(b"\xff")), ("dev/P.jl/bad.jl", bytearray(b"\xff"))]
    files, out, left = spark.createDataFrame(rows, "path string, content binary"), str(tmp_path / "out"), str(tmp_path / "left")
    got = jobs.build_corpus(files, out, profile="syntax", rejects=left)
    assert [r.file_path for r in got.collect()] == ["dev/P.jl/a.jl"]
    assert [r.path for r in spark.read.parquet(left).collect()] == ["dev/P.jl/bad.jl"]
    got = jobs.build_corpus(files, out, rejects=left)
    assert sorted(r.file_path for r in got.collect()) == sorted(paths[:4])


def test_cluster_job(spark, sf):
    embeddings = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = jobs.explore_clusters(embeddings, "vec_id", fraction=0.5, ks=[2, 3]).collect()
    assert [r["k"] for r in rows] == [2, 3]
