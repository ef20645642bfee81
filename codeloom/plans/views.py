"""Code-like tables derived from the given ones.

The SQL runs unchanged on Spark and on the oracle. ``{documents}`` and the like
stand for the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.session import spread

#: One function per document. Signature and documentation hang on ``n_chars``, so
#: copies of a text become copies of a function in another file.
CODE_FUNCTIONS = """
SELECT
  'dev' || cast(doc_id % 7 AS string) AS author,
  CASE WHEN source = 'src0' THEN 'HumanEval.jl' ELSE source || '.jl' END AS project,
  CASE WHEN doc_id % 11 = 0 THEN 'test/f' ELSE 'src/f' END || cast(doc_id AS string) || '.jl' AS file_path,
  cast(1 AS int) AS line_number,
  CASE WHEN k = 0 THEN 'single-line' WHEN k = 1 THEN 'anonymous' ELSE 'basic' END AS type,
  CASE WHEN k = 0 THEN name || '(x) ='
       WHEN k = 1 THEN 'Anonymous Function assigned to ' || name || '(x) ='
       WHEN n_chars % 13 = 0 THEN 'function test_' || name || '(x::Int)'
       ELSE 'function ' || name || CASE WHEN n_chars % 2 = 0 THEN '(x::Int)' ELSE '(x)' END END AS signature,
  CASE WHEN n_chars % 3 = 0 THEN ''
       WHEN n_chars % 3 = 1 THEN name || '(x)' || chr(10) || text
       WHEN n_chars % 4 = 0 THEN text || chr(10) || chr(10) || '# Example'
       ELSE text END AS documentation,
  replace(text, '. ', ';' || chr(10)) || chr(10) || '# --' || chr(10)
       || CASE WHEN n_chars % 5 = 0 THEN '# note ' || lang || chr(10) ELSE '' END
       || CASE WHEN n_chars % 17 = 0 THEN '@testset x' || chr(10) ELSE '' END || '  return x' AS body
FROM (SELECT doc_id, lang, source, text, n_chars, n_chars % 10 AS k,
             'fn_' || cast(n_chars % 500 AS string) AS name
      FROM {documents}) AS base
"""

#: Benchmark prompts: a docstring and a header.
PROMPTS = """
SELECT item_id, '\"\"\"' || text || '\"\"\"' || chr(10)
       || 'function fn_' || cast(item_id * 7 % 500 AS string) || '(x)' AS prompt
FROM {benchmark}
"""

#: One source file per function; bodies that must fit a line lose line ends, quotes and comment marks.
CODE_FILES = """
SELECT author || '/' || project || '/' || file_path AS path,
  CASE WHEN documentation = '' THEN ''
       ELSE '\"\"\"' || chr(10) || documentation || chr(10) || '\"\"\"' || chr(10) END
  || CASE WHEN type = 'basic' THEN signature || chr(10) || body || chr(10) || 'end' || chr(10)
          WHEN type = 'single-line' THEN signature || ' x + 1 ' || one_line || ' # c' || chr(10)
          ELSE replace(replace(signature, 'Anonymous Function assigned to ', ''), '(x) =', ' = (x) -> x + 1 ')
               || one_line || ' # c' || chr(10) END AS content
FROM (SELECT *, translate(body, chr(10) || chr(13) || '#' || chr(34), '    ') AS one_line FROM {code_functions}) AS base
"""

#: Snippets of files with up to eight definitions: docstrings, comment runs, blank
#: lines between, nested blocks, ``begin`` and ``let`` blocks, and lines that define
#: nothing. Texts stand as comments unchanged, and as code without two block words.
SNIPPETS = """
SELECT doc_id, path, name, kind, lead, code,
  CASE WHEN doc_id % 3 = 0 THEN 'const c' || cast(doc_id AS string) || ' = 1' || chr(10) ELSE '' END AS tail
FROM (SELECT doc_id, name, kind,
  'dev' || cast(bundle % 7 AS string) || '/lib' || cast(bundle % 20 AS string) || '.jl/src/m'
    || cast(bundle AS string) || '.jl' AS path,
  CASE WHEN doc_id % 4 = 0 THEN '\"\"\"' || chr(10) || '    ' || first_words || chr(10) || '\"\"\"' || chr(10)
       WHEN doc_id % 4 = 1 THEN '\"\"\"' || chr(10) || first_words || chr(10) || '\"\"\"' || chr(10) || '# aside' || chr(10) || chr(10)
       WHEN doc_id % 4 = 2 THEN '# about ' || name || chr(10) || '## more #' || chr(10)
       ELSE '# lost' || chr(10) || 'using Base' || chr(10) END AS lead,
  CASE WHEN kind = 0 THEN name || '(x) = x + ' || cast(n_chars AS string) || ' # c' || chr(10)
       WHEN kind = 1 THEN name || '(x, y) = begin' || chr(10) || '  z = x # add' || chr(10) || '  z' || chr(10) || 'end' || chr(10)
       WHEN kind = 2 THEN name || ' = (a, b) -> a * b # d' || chr(10)
       WHEN kind = 3 THEN 'function ' || name || '!(x)' || chr(10) || '  if x # why' || chr(10) || '    1' || chr(10)
                     || '  end' || chr(10) || '  2' || chr(10) || 'end' || chr(10)
       WHEN kind = 6 THEN 'function ' || name || '(x::Int)' || chr(10) || '  # ' || replace(text, chr(10), chr(10) || '  # ')
                     || chr(10) || '  x' || chr(10) || 'end # ' || name || chr(10)
       WHEN kind = 7 THEN name || '(x) = let y = x' || chr(10) || '  y + ' || cast(n_chars AS string) || chr(10) || 'end' || chr(10)
       WHEN kind = 8 THEN name || ' = (a) -> begin' || chr(10) || '  z # e' || chr(10) || 'end' || chr(10)
       ELSE 'function ' || name || '(x::Int)' || chr(10) || '  ' || replace(prose, '. ', ';' || chr(10) || '  ')
            || chr(10) || 'end # ' || name || chr(10) END AS code
  FROM (SELECT doc_id, n_chars, text, 'fn_' || cast(n_chars % 500 AS string) AS name, doc_id % 9 AS kind,
               cast(floor(doc_id / 8) AS bigint) AS bundle, split_part(text, '.', 1) AS first_words,
               replace(replace(text, 'for', 'fro'), 'do', 'od') AS prose
        FROM {documents}) AS base) AS parts
"""

#: One file a document: its whole text in a string, in a block comment, and in a string inside a function.
QUOTED_FILES = """
SELECT doc_id, path, above, name, inner_code, n,
  above || 'function ' || name || '(x)' || chr(10) || inner_code || chr(10) || 'end' || chr(10)
    || 'end' || chr(10) || 'g(x) = x +' || chr(10) || '  ' || cast(n AS string) || chr(10) AS content
FROM (SELECT doc_id, path, name, n,
    'show(\"\"\"' || chr(10) || quoted || chr(10) || '\"\"\")' || chr(10) || '#= module Z' || chr(10) || 'function hidden(x)' || chr(10)
      || noted || chr(10) || '#= inner =#' || chr(10) || 'end' || chr(10) || '=#' || chr(10)
      || 'module M' || cast(doc_id % 5 AS string) || chr(10) AS above,
    '  s = \"\"\"' || chr(10) || quoted || chr(10) || '  \"\"\"' || chr(10) || '  c = ' || chr(39) || chr(34) || chr(39) || ' # mark' || chr(10)
      || '  if x == \"end ' || chr(36) || '(f(\"b\"))\"' || chr(10) || '    1' || chr(10) || '  end' AS inner_code
  FROM (SELECT doc_id, length(plain) AS n, 'fn_' || cast(length(plain) % 500 AS string) AS name,
      'dev' || cast(doc_id % 7 AS string) || '/lib.jl/src/d' || cast(doc_id AS string) || '.jl' AS path,
      replace(replace(replace(plain, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(36), chr(92) || chr(36)) AS quoted,
      replace(replace(plain, '#', '# '), '=#', '= #') AS noted
    FROM (SELECT doc_id, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS plain
          FROM {documents}) AS texts) AS escaped) AS parts
"""

#: Source-like paths and contents from web pages.
PAGE_FILES = """
SELECT page_id, split_part(url, '/', 3) || '/p' || cast(page_id % 9 AS string)
  || CASE page_id % 6 WHEN 0 THEN '/.github/x.jl' WHEN 1 THEN '/src/TestUtils.jl' WHEN 2 THEN '/README.md'
                      WHEN 3 THEN '/src/.git/a.jl' WHEN 4 THEN '/a.jl' ELSE '/src/b.jl' END AS path,
  html AS content
FROM {pages}
"""

#: One benchmark result per answered turn of a conversation.
RESULT_DOCUMENTS = """
SELECT 'Problem_' || cast(q.conv_id * 100 + q.turn AS string) || '_x' AS name, q.text AS prompt,
  CASE WHEN q.conv_id % 3 = 0 THEN '' ELSE chr(10) || '@test ' || q.role END AS tests,
  q.text || a.text || CASE WHEN q.conv_id % 3 = 0 THEN '' ELSE chr(10) || '@test ' || q.role END AS program,
  CASE WHEN length(a.text) % 2 = 0 THEN 'OK' ELSE 'Exception' END AS status
FROM {conversations} AS q JOIN {conversations} AS a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
WHERE q.role = 'user' AND a.role = 'assistant'
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "conversations"), "conv_id")


def code_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CODE_FUNCTIONS, documents=documents(spark, sf_dir))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PROMPTS, benchmark=table(spark, sf_dir, "benchmark"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CODE_FILES, code_functions=code_functions(spark, sf_dir))


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SNIPPETS, documents=documents(spark, sf_dir))


def quoted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(QUOTED_FILES, documents=documents(spark, sf_dir)).select("path", "content")


def code_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        """SELECT path, listagg(lead || code || tail, '') WITHIN GROUP (ORDER BY doc_id) AS content
           FROM {snippets} GROUP BY path""",
        snippets=snippets(spark, sf_dir),
    )


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PAGE_FILES, pages=spread(table(spark, sf_dir, "pages"), "page_id"))


def result_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        "SELECT name, prompt, tests, array(named_struct('program', program, 'status', status)) AS results FROM {r}",
        r=spark.sql(RESULT_DOCUMENTS, conversations=conversations(spark, sf_dir)),
    )


def oracle_views(*names: str) -> str:
    """The views as a ``WITH`` clause for the oracle, in order of need."""
    sql = {
        "code_functions": CODE_FUNCTIONS,
        "prompts": PROMPTS,
        "code_files": CODE_FILES,
        "snippets": SNIPPETS,
        "quoted_files": QUOTED_FILES,
        "page_files": PAGE_FILES,
        "result_documents": RESULT_DOCUMENTS,
    }
    given = ["documents", "benchmark", "pages", "conversations", *sql]
    bodies = [f"{name} AS ({sql[name].format(**{g: g for g in given})})" for name in sql if name in names]
    return "WITH " + ",\n".join(bodies)
