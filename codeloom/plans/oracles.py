"""SQL counterparts of the registered queries, for DuckDB.

Written on their own: windows and joins where the engine uses hashes, aggregates
or expressions on one row, and known parts where the engine takes text apart.
"""

from __future__ import annotations

from codeloom.functions.text import KEYWORDS, WHITESPACE
from codeloom.operators.filters import EXCLUDED_REPOS
from codeloom.plans.views import oracle_views

ORACLES: dict[str, str] = {}

KEY = "author, project, file_path, line_number"
ID = "author, project, file_path"
NL = "chr(10)"
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
TOKEN = r"<\|endoftext\|>|<\|unk\|>|[A-Za-z0-9_]+|[^A-Za-z0-9_\t\n\x0b\f\r ]"


def oracle(name: str, sql: str, *views: str) -> None:
    with_ = oracle_views(*views)
    recursive = "WITH RECURSIVE "
    if views and sql.startswith(recursive):
        sql = recursive + with_.removeprefix("WITH ") + ", " + sql.removeprefix(recursive)
    elif views and sql.lstrip().upper().startswith("WITH "):
        sql = with_ + ", " + sql.lstrip()[5:]
    elif views:
        sql = with_ + "\n" + sql
    ORACLES[name] = sql


def strip(x: str) -> str:
    return f"trim({x}, '{WHITESPACE}')"


def lines(x: str) -> str:
    return f"string_split({x}, {NL})"


def join_lines(x: str) -> str:
    return f"coalesce(array_to_string({x}, {NL}), '')"


def joined(x: str) -> str:
    return f"coalesce(array_to_string({x}, '|'), '')"


def code_lines(x: str) -> str:
    return (
        f"list_filter(list_transform({lines(x)}, lambda l: {strip('l')}), "
        "lambda s: s <> '' AND NOT starts_with(s, '#'))"
    )


def normalized(x: str) -> str:
    return join_lines(code_lines(x))


def cleaned(x: str) -> str:
    keep = f"NOT starts_with({strip('l')}, '#') OR length(regexp_replace(l, '[^a-zA-Z]', '', 'g')) >= 3"
    return join_lines(f"list_filter({lines(x)}, lambda l: {keep})")


def extract(x: str, pattern: str) -> str:
    return f"nullif(regexp_extract({x}, '{pattern}', 1), '')"


def plain_name(sig: str) -> str:
    return extract(sig, rf"^function{WS}+([a-zA-Z_][a-zA-Z0-9_]*)\(")


def searched_name(x: str) -> str:
    return extract(x, r"function ([^(]+)\(")


def leading_name(sig: str) -> str:
    return extract(sig, rf"^function{WS}+([^(]+)")


def prompt_name(x: str) -> str:
    return searched_name(f"""regexp_replace({x}, '(?s)\"\"\".*?\"\"\"', '', 'g')""")


def good_doc(doc: str = "documentation", sig: str = "signature") -> str:
    d, name = strip(doc), plain_name(strip(sig))
    return f"""coalesce({d} <> '' AND {name} IS NOT NULL AND (starts_with({d}, {name})
        OR contains({d}, '# Example') OR contains({d}, '```jldoctest') OR contains({d}, '```julia-repl')), false)"""


def strip_signature(doc: str = "documentation", sig: str = "signature") -> str:
    name = leading_name(sig)
    pattern = rf"concat('(?s)^(?:(?:function )?{WS}*\Q', {name}, '\E{WS}*\(.*?\){WS}*)+')"
    return (
        f"CASE WHEN {name} IS NULL THEN {doc} "
        f"ELSE trim(regexp_replace({doc}, {pattern}, ''), {NL}) END"
    )


def first_line(doc: str) -> str:
    dot, gap = f"strpos({doc}, '.')", f"strpos({doc}, {NL} || {NL})"
    return f"""CASE WHEN {dot} > 0 AND ({gap} = 0 OR {dot} < {gap}) THEN substr({doc}, 1, {dot})
        WHEN {gap} > 0 THEN substr({doc}, 1, {gap}) ELSE {doc} END"""


def wrapped(doc: str) -> str:
    return f"""'\"\"\"' || {doc} || {NL} || '\"\"\"'"""


END_OF_TEXT = "'<|endoftext|>'"


def model_input(doc: str) -> str:
    return f"{END_OF_TEXT} || {wrapped(doc)} || {NL} || signature || {NL}"


MODEL_OUTPUT = f"body || {NL} || 'end' || {END_OF_TEXT}"


def complete(doc: str) -> str:
    return f"{model_input(doc)} || {MODEL_OUTPUT}"


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '{TOKEN}')"


DOCUMENTED = f"({searched_name('signature')} IS NOT NULL AND type = 'basic' AND documentation <> '')"
ENCODABLE = f"""(NOT contains(body, '@testset') AND NOT contains(lower(signature), 'function test')
    AND len({tokens(wrapped('documentation'))}) >= 10 AND len({tokens(complete('documentation'))}) <= 2048)"""

# Curation ---------------------------------------------------------------------

CURATED = f"""
WITH candidates AS (
  SELECT *, {normalized('body')} AS norm, len({code_lines('body')}) AS n_code FROM code_functions
  WHERE project <> 'HumanEval.jl' AND type = 'basic' AND NOT contains(lower(signature), 'test')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY {KEY}) AS copy FROM candidates),
curated AS (
  SELECT *, CASE WHEN {good_doc()} THEN 'good' ELSE 'bad' END AS doc_quality FROM ranked
  WHERE copy = 1 AND contains(signature, '::') AND n_code < 25)
"""

oracle(
    "curate_quality_split",
    CURATED + "SELECT project, doc_quality, count(*) AS functions FROM curated GROUP BY ALL",
    "code_functions",
)
oracle(
    "curated_functions",
    CURATED + f"SELECT {KEY}, doc_quality, md5({cleaned('body')}) AS body_md5 FROM curated",
    "code_functions",
)
oracle(
    "curate_counters",
    CURATED
    + f"""SELECT (SELECT count(*) FROM code_functions) AS total_functions,
      count(*) AS candidates,
      count_if(copy > 1)::BIGINT AS duplicates,
      count_if(copy = 1 AND NOT starts_with({strip('signature')}, 'function'))::BIGINT AS non_standard_signatures,
      count_if(copy = 1 AND NOT contains(signature, '::'))::BIGINT AS not_annotated,
      (SELECT count(*) FROM curated) AS kept,
      (SELECT count(*) FROM curated WHERE doc_quality = 'good') AS good_doc,
      (SELECT count(*) FROM curated WHERE doc_quality = 'bad') AS bad_doc
    FROM ranked""",
    "code_functions",
)
oracle(
    "dedup_normalized_body",
    f"""SELECT {KEY} FROM code_functions
        QUALIFY row_number() OVER (PARTITION BY {normalized('body')} ORDER BY {KEY}) = 1""",
    "code_functions",
)
oracle(
    "dedup_across_runs",
    f"""WITH runs AS (SELECT *, CASE WHEN coalesce(documentation, '') <> '' THEN 0 ELSE 1 END::BIGINT AS batch
        FROM code_functions)
        SELECT {KEY}, batch FROM runs
        QUALIFY row_number() OVER (PARTITION BY {normalized('body')} ORDER BY batch, {KEY}) = 1""",
    "code_functions",
)
oracle(
    "dedup_doc_sig_body",
    f"""SELECT {KEY} FROM code_functions
        QUALIFY row_number() OVER (PARTITION BY documentation, signature, body ORDER BY {KEY}) = 1""",
    "code_functions",
)
oracle(
    "decontaminate_names",
    f"""SELECT {KEY}, signature FROM code_functions WHERE {DOCUMENTED}
        AND {searched_name('signature')} NOT IN
          (SELECT {prompt_name('prompt')} AS n FROM prompts WHERE n IS NOT NULL)""",
    "code_functions",
    "prompts",
)
oracle("documented_basic", f"SELECT {KEY} FROM code_functions WHERE {DOCUMENTED}", "code_functions")
oracle(
    "project_exclusion",
    "SELECT project, count(*) AS functions FROM code_functions WHERE project <> 'HumanEval.jl' GROUP BY ALL",
    "code_functions",
)
oracle(
    "test_function_filters",
    f"""SELECT {KEY}, contains(lower(signature), 'function test') AS names_test,
        contains(lower(signature), 'test') AS has_test, contains(body, '@testset') AS testset
        FROM code_functions""",
    "code_functions",
)
oracle(
    "short_annotated",
    f"""SELECT {KEY} FROM code_functions
        WHERE contains(signature, '::') AND len({code_lines('body')}) < 25""",
    "code_functions",
)
oracle(
    "project_regroup",
    """WITH placed AS (
      SELECT *, CAST('0x' || substr(md5(file_path), 1, 8) AS BIGINT) AS bucket FROM code_functions),
    parts AS (SELECT *, bucket % 3 AS part FROM placed)
    SELECT author, project, part, count(*) AS functions,
      md5(string_agg(file_path || ':' || md5(body), '|' ORDER BY file_path, line_number)) AS content_md5
    FROM parts GROUP BY author, project, part""",
    "code_functions",
)
oracle(
    "projects_flattened",
    f"SELECT {KEY}, md5(signature) AS signature_md5 FROM code_functions",
    "code_functions",
)

# Corpus figures ---------------------------------------------------------------

oracle(
    "totals",
    """SELECT count(DISTINCT author) AS authors, count(DISTINCT (author, project)) AS projects,
       count(*) AS functions FROM code_functions""",
    "code_functions",
)
oracle(
    "function_types",
    """SELECT type, count(f.body) AS functions,
       round(coalesce(100.0 * count_if(documentation <> '') / nullif(count(f.body), 0), 0), 6) AS pct_documented,
       round(coalesce(100.0 * count_if(contains(body, '#')) / nullif(count(f.body), 0), 0), 6) AS pct_commented
    FROM (VALUES ('basic'), ('single-line'), ('anonymous')) AS t(type) LEFT JOIN code_functions AS f USING (type)
    GROUP BY type""",
    "code_functions",
)
oracle(
    "encode_audit",
    f"""WITH a AS (SELECT * FROM code_functions WHERE project <> 'HumanEval.jl'),
    b AS (SELECT * FROM a WHERE {DOCUMENTED}),
    c AS (SELECT * FROM b WHERE NOT contains(body, '@testset')),
    d AS (SELECT * FROM c WHERE NOT contains(lower(signature), 'function test')),
    n AS (SELECT (SELECT count(*) FROM code_functions) AS s, (SELECT count(*) FROM a) AS a,
          (SELECT count(*) FROM b) AS b, (SELECT count(*) FROM c) AS c, (SELECT count(*) FROM d) AS d)
    SELECT 1::BIGINT AS step, 'outside benchmark' AS stage, s AS rows_before, a AS rows_after FROM n
    UNION ALL SELECT 2, 'documented basic', a, b FROM n
    UNION ALL SELECT 3, 'no test set', b, c FROM n
    UNION ALL SELECT 4, 'no test function', c, d FROM n""",
    "code_functions",
)
oracle("distinct_authors", "SELECT DISTINCT author FROM code_functions", "code_functions")

# Text rules -------------------------------------------------------------------

oracle(
    "newline_unify",
    """SELECT doc_id, md5(replace(replace(replace(replace(text, '. ', '.' || chr(13) || chr(10)), ',', chr(13)),
       chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS text_md5 FROM documents""",
)
oracle("comment_cleanup", f"SELECT {ID}, md5({cleaned('body')}) AS body_md5 FROM code_functions", "code_functions")
oracle(
    "body_normalized", f"SELECT {ID}, md5({normalized('body')}) AS body_md5 FROM code_functions", "code_functions"
)
oracle(
    "code_line_counts",
    f"SELECT {ID}, len({code_lines('body')}) AS code_lines FROM code_functions",
    "code_functions",
)
oracle(
    "function_names",
    f"""SELECT {ID}, {plain_name('signature')} AS plain_name, {searched_name('signature')} AS searched_name,
        {leading_name('signature')} AS leading_name, contains(signature, '::') AS annotated,
        starts_with({strip('signature')}, 'function') AS standard FROM code_functions""",
    "code_functions",
)
oracle("good_doc_flags", f"SELECT {ID}, {good_doc()} AS good_doc FROM code_functions", "code_functions")
oracle("doc_strip_signature", f"SELECT {ID}, md5({strip_signature()}) AS doc_md5 FROM code_functions", "code_functions")
oracle("doc_first_line", f"SELECT {ID}, {first_line('documentation')} AS first_line FROM code_functions", "code_functions")
oracle(
    "doc_wrapped",
    f"""SELECT {ID}, md5({wrapped("replace(documentation, ' ', '----')")}) AS kept_md5,
        md5({wrapped("regexp_replace(replace(documentation, ' ', '----'), '---+', '', 'g')")}) AS stripped_md5
        FROM code_functions""",
    "code_functions",
)
oracle("prompt_names", f"SELECT item_id, {prompt_name('prompt')} AS name FROM prompts", "prompts")
oracle(
    "complete_functions",
    f"""SELECT {ID}, md5({model_input('documentation')}) AS input_md5, md5({MODEL_OUTPUT}) AS output_md5,
        md5({complete('documentation')}) AS complete_md5 FROM code_functions""",
    "code_functions",
)
oracle(
    "comment_split",
    f"""WITH parts AS (
      SELECT doc_id, list_transform(string_split(replace(text, 'e', '#'), '#'), lambda x: {strip('x')}) AS x
      FROM documents)
    SELECT doc_id, md5(x[1]) AS code_md5, len(x) - 1 AS comments, md5({joined('x[2:]')}) AS comments_md5
    FROM parts""",
)
oracle(
    "inline_comments",
    f"""SELECT {ID}, {joined("regexp_extract_all(body, '#.*')")} AS marked,
        {joined(f"list_transform(regexp_extract_all(body, '#(.*)', 1), lambda x: {strip('x')})")} AS bare
        FROM code_functions""",
    "code_functions",
)
oracle(
    "keyword_scrub",
    rf"""WITH runs AS (SELECT {ID}, regexp_extract_all(body, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') AS x FROM code_functions)
    SELECT {ID}, md5(trim(regexp_replace(array_to_string(list_transform(x, lambda w:
        CASE WHEN w IN ({", ".join(repr(w) for w in KEYWORDS)}) THEN ' ' ELSE w END), ''),
        '[^A-Za-z0-9_]+', ' ', 'g'), ' ')) AS scrubbed_md5 FROM runs""",
    "code_functions",
)
oracle(
    "rebuilt_functions",
    f"""SELECT {ID}, md5(signature || {NL} || body || {NL} || 'end') AS function_md5 FROM code_functions
        WHERE type = 'basic'""",
    "code_functions",
)

# Files and repositories -------------------------------------------------------

oracle(
    "source_paths",
    r"""SELECT page_id, string_split(path, '/')[1] AS author, string_split(path, '/')[2] AS project,
      ends_with(path, '.jl') AND coalesce(string_split(path, '/')[3] NOT IN ('.git', '.github', '.vscode')
        OR len(string_split(path, '/')) < 4, true) AS kept,
      ends_with(path, '.jl') AND NOT contains(lower(path), 'test') AND len(string_split(path, '/')) >= 3
        AS project_source
    FROM page_files""",
    "page_files",
)
LINES = f"(length(content) - length(replace(content, {NL}, '')) + CASE WHEN ends_with(content, {NL}) THEN 0 ELSE 1 END)"
oracle(
    "long_file_gate",
    f"SELECT path, {LINES} AS lines, {LINES} <= 10000 AS fits, {LINES} <= 30 AS fits_30 FROM code_files",
    "code_functions",
    "code_files",
)
oracle("utf8_gate", "SELECT doc_id FROM documents WHERE doc_id % 9 <> 0")
REJECTED = f"""
WITH cut AS (
  SELECT path, content, f.type, length(path) % 4 = 0 AND f.type = 'basic' AS open
  FROM code_files JOIN (SELECT author || '/' || project || '/' || file_path AS path, type FROM code_functions) AS f
  USING (path)),
rejected AS (
  SELECT path, CASE WHEN ends_with(path, '7.jl') THEN 'not utf-8'
    WHEN {LINES} - CASE WHEN open THEN 1 ELSE 0 END > 60 THEN 'too many lines'
    WHEN open THEN 'unclosed function' END AS reason FROM cut)
"""
oracle(
    "rejected_files",
    REJECTED + "SELECT path, reason FROM rejected WHERE reason IS NOT NULL",
    "code_functions",
    "code_files",
)
oracle(
    "rejects_by_reason",
    REJECTED + "SELECT reason, count(*) AS files FROM rejected WHERE reason IS NOT NULL GROUP BY reason",
    "code_functions",
    "code_files",
)
oracle(
    "file_count",
    """SELECT count(*) AS files FROM page_files WHERE ends_with(path, '.jl') AND page_id % 6 <> 0""",
    "page_files",
)
REPOSITORIES = f"""
WITH repositories AS (
  SELECT doc_id, CASE WHEN doc_id % 40 = 0 THEN '{EXCLUDED_REPOS[0]}'
    ELSE 'lang/' || source || '_' || doc_id END AS name FROM documents)
"""
oracle(
    "exclusion_anti",
    REPOSITORIES + f"SELECT name FROM repositories WHERE name NOT IN ({', '.join(repr(r) for r in EXCLUDED_REPOS)})",
)
oracle(
    "resume_anti",
    REPOSITORIES
    + """SELECT name FROM repositories WHERE name NOT IN
        (SELECT name FROM repositories JOIN labels USING (doc_id) WHERE quality = 1)""",
)
oracle(
    "first_n_authors",
    """WITH f AS (SELECT author || '-' || author || '-' || project AS a, author, project, file_path FROM code_functions),
    ranked AS (SELECT author || '-' || project AS author, file_path,
      dense_rank() OVER (ORDER BY author || '-' || project) AS r FROM f)
    SELECT author, file_path FROM ranked WHERE r <= 10""",
    "code_functions",
)

# Extraction -------------------------------------------------------------------

#: Lines with a docstring mask; in these files quotes stand on lines of their own.
LINE_TABLE = f"""
WITH numbered AS (
  SELECT path, unnest({lines('content')}) AS line, generate_subscripts({lines('content')}, 1) AS ln FROM code_files),
masked AS (
  SELECT *, trim(line) = '\"\"\"' AS quotes,
    sum(CASE WHEN trim(line) = '\"\"\"' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ln) AS seen
  FROM numbered),
docs AS (
  SELECT path, trim({strip(f"string_agg({strip('line')}, {NL} ORDER BY ln)")}, '"') AS doc
  FROM masked WHERE seen % 2 = 1 AND NOT quotes GROUP BY path),
code AS (SELECT path, ln, line FROM masked WHERE seen % 2 = 0 AND NOT quotes)
"""
oracle(
    "extract_basic",
    LINE_TABLE
    + rf""", flagged AS (SELECT *, regexp_matches(line, '^\s*end\b') AS is_end,
      regexp_matches(line, '^\s*function\s+[A-Za-z_][\w!?@#$%^&*+-]*\s*\([^)]*\)\s*$') AS is_head FROM code),
    islands AS (SELECT *, coalesce(sum(is_end::INT) OVER
      (PARTITION BY path ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM flagged),
    opened AS (SELECT *, min(CASE WHEN is_head THEN ln END) OVER (PARTITION BY path, island) AS head,
      max(is_end::INT) OVER (PARTITION BY path, island) AS closed FROM islands),
    functions AS (SELECT path, head, max(CASE WHEN ln = head THEN line END) AS signature,
      {strip(f"coalesce(string_agg(CASE WHEN ln > head AND NOT is_end THEN line END, {NL} ORDER BY ln), '')")} AS body
      FROM opened WHERE head IS NOT NULL AND closed = 1 GROUP BY path, island, head)
    SELECT path AS file_path, head AS line_number, signature, md5(coalesce({strip('doc')}, '')) AS doc_md5,
      md5(body) AS body_md5, {joined("regexp_extract_all(body, '#.*')")} AS comments
    FROM functions LEFT JOIN docs USING (path)""",
    "code_functions",
    "code_files",
)
oracle(
    "extract_single_line",
    LINE_TABLE
    + rf"""SELECT path AS file_path, ln AS line_number, regexp_extract(line, '^(\w+\(\w+\) =)', 1) AS signature,
      md5(coalesce({strip('doc')}, '')) AS doc_md5,
      md5({strip(r"regexp_extract(line, '= ([^#]*)', 1)")}) AS body_md5,
      {strip("regexp_extract(line, '#(.*)', 1)")} AS comments
    FROM code LEFT JOIN docs USING (path) WHERE regexp_matches(line, '^fn_[0-9]+\(x\) = x \+ 1')""",
    "code_functions",
    "code_files",
)
oracle(
    "extract_anonymous",
    LINE_TABLE
    + rf"""SELECT path AS file_path, ln AS line_number,
      'Anonymous Function assigned to ' || regexp_extract(line, '^(\w+)', 1) || '(x) =' AS signature,
      md5(coalesce({strip('doc')}, '')) AS doc_md5,
      md5({strip(r"regexp_extract(line, '-> ([^#]*)', 1)")}) AS body_md5,
      {strip("regexp_extract(line, '#(.*)', 1)")} AS comments
    FROM code LEFT JOIN docs USING (path) WHERE regexp_matches(line, '^fn_[0-9]+ = \(x\) -> x \+ 1')""",
    "code_functions",
    "code_files",
)


def count_newlines(x: str) -> str:
    return f"(length({x}) - length(replace({x}, {NL}, '')))"


#: What each snippet must yield, from its known parts.
EXPECTED = f"""
WITH placed AS (
  SELECT *, coalesce(sum({count_newlines('lead || code || tail')}) OVER
      (PARTITION BY path ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      + {count_newlines('lead')} + 1 AS ln,
    regexp_extract(lead, '(?s)^\"\"\"(.*)\"\"\"', 1) AS quoted,
    regexp_extract(code, '(?s)^[^\n]*\n(.*)\nend[^\n]*\n$', 1) AS inner_code
  FROM snippets),
expected AS (
  SELECT path AS file_path, string_split(path, '/')[1] AS author, string_split(path, '/')[2] AS project,
    CAST(ln AS BIGINT) AS line_number, kind, inner_code, doc_id % 4 = 0 AS has_doc, lead AS quoted_text,
    CASE WHEN kind IN (0, 1, 7) THEN 'single-line' WHEN kind IN (2, 8) THEN 'anonymous' ELSE 'basic' END AS type,
    CASE kind WHEN 0 THEN name || '(x) =' WHEN 7 THEN name || '(x) =' WHEN 1 THEN name || '(x, y) = begin'
      WHEN 2 THEN 'Anonymous Function assigned to ' || name || '(a, b) ='
      WHEN 8 THEN 'Anonymous Function assigned to ' || name || '(a) = begin'
      WHEN 3 THEN 'function ' || name || '!(x)' ELSE 'function ' || name || '(x::Int)' END AS signature,
    CASE WHEN doc_id % 4 = 2 THEN 'about ' || name || {NL} || 'more'
      WHEN doc_id % 4 = 3 OR (doc_id % 4 = 1 AND kind IN (2, 8)) THEN ''
      ELSE {strip(f"trim({strip(join_lines(f'list_transform({lines("quoted")}, lambda l: {strip("l")})'))}, chr(34))")}
      END AS documentation,
    CASE kind WHEN 0 THEN regexp_extract(code, '= (.*) # c', 1) WHEN 2 THEN 'a * b'
      WHEN 1 THEN 'begin' || {NL} || 'z = x # add' || {NL} || '  z' || {NL} || 'end'
      WHEN 7 THEN 'let y = x' WHEN 8 THEN 'begin' || {NL} || 'z # e' || {NL} || 'end'
      WHEN 3 THEN 'if x # why' || {NL} || '    1' ELSE {strip('inner_code')} END AS body,
    CASE kind WHEN 0 THEN 'c' WHEN 1 THEN 'add' WHEN 2 THEN 'd' WHEN 3 THEN '# why' WHEN 7 THEN '' WHEN 8 THEN 'e'
      ELSE {joined("regexp_extract_all(inner_code, '#.*')")} END AS comments
  FROM placed)
"""
oracle(
    "extract_bundles",
    EXPECTED
    + """SELECT author, project, file_path, line_number, type, signature, md5(documentation) AS doc_md5,
         md5(body) AS body_md5, comments FROM expected""",
    "snippets",
)
oracle(
    "extract_balanced",
    EXPECTED
    + f"""SELECT file_path, line_number, signature, md5({strip('inner_code')}) AS body_md5
          FROM expected WHERE type = 'basic'""",
    "snippets",
)
oracle(
    "extract_syntax",
    EXPECTED
    + rf""", shaped AS (
      SELECT *, type AS t,
        regexp_extract(body, '(?s)^begin\n(.*)$', 1) AS block FROM expected)
    SELECT file_path, line_number, t AS type,
      CASE kind WHEN 0 THEN replace(signature, ' =', '') WHEN 1 THEN replace(signature, ' = begin', '')
        WHEN 7 THEN replace(signature, ' =', '') WHEN 8 THEN regexp_extract(signature, 'to (\w+)', 1) || ' = (a) -> begin'
        WHEN 2 THEN regexp_extract(signature, 'to (\w+)', 1) || ' = (a, b) -> a * b' ELSE signature END AS signature,
      md5(CASE WHEN has_doc AND kind NOT IN (2, 8) THEN {strip('quoted_text')} ELSE '' END) AS doc_md5,
      md5(CASE kind WHEN 0 THEN body WHEN 2 THEN 'a * b' WHEN 1 THEN 'begin' || {NL} || '  ' || block
        WHEN 7 THEN 'let y = x' || {NL} || inner_code || {NL} || 'end' WHEN 8 THEN 'begin' || {NL} || inner_code || {NL} || 'end'
        ELSE {join_lines(f"list_transform({lines('inner_code')}, lambda l: {strip('l')})")} || {NL} || 'end' END) AS body_md5,
      CASE WHEN kind IN (0, 2, 7) THEN '' WHEN kind = 1 THEN '# add' WHEN kind = 8 THEN '# e' ELSE comments END AS comments
    FROM shaped WHERE kind <> 3""",
    "snippets",
)
oracle(
    "extract_quoted",
    f"""SELECT 'balanced' AS way, path AS file_path, {count_newlines('above')} + 1 AS line_number,
      'function ' || name || '(x)' AS signature, 'M' || (doc_id % 5) AS module, md5({strip('inner_code')}) AS body_md5
    FROM quoted_files
    UNION ALL SELECT 'syntax', path, {count_newlines('above')} + 1, 'function ' || name || '(x)', 'M' || (doc_id % 5),
      md5({join_lines(f"list_transform({lines('inner_code')}, lambda l: {strip('l')})")} || {NL} || 'end')
    FROM quoted_files
    UNION ALL SELECT 'syntax', path, {count_newlines('content')} - 1, 'g(x)', NULL, md5('x +' || {NL} || '  ' || n)
    FROM quoted_files""",
    "quoted_files",
)
oracle(
    "module_attribution",
    EXPECTED
    + rf"""SELECT file_path, regexp_extract(file_path, '(m[0-9]+)\.jl', 1) AS module,
          line_number + 1 AS line_number FROM expected
    UNION ALL SELECT path, NULL, CAST(sum({count_newlines('lead || code || tail')}) + 3 AS BIGINT) FROM snippets GROUP BY path""",
    "snippets",
)
oracle(
    "numbered_lines",
    f"""WITH numbered AS (SELECT path, unnest({lines('content')}) AS line,
        generate_subscripts({lines('content')}, 1) AS ln FROM code_files)
    SELECT path, count(*) AS lines, CAST(sum(ln * length(line)) AS BIGINT) AS weight FROM numbered GROUP BY path""",
    "code_functions",
    "code_files",
)
oracle(
    "bundle_segments",
    """SELECT path, md5(string_agg(lead || code || tail, '' ORDER BY doc_id)) AS content_md5
       FROM snippets GROUP BY path""",
    "snippets",
)

# Encoding ---------------------------------------------------------------------

oracle("token_counts", f"SELECT doc_id, len({tokens('text')}) AS tokens FROM documents")
oracle("token_gate", f"SELECT {KEY} FROM code_functions WHERE {ENCODABLE}", "code_functions")


def vocabulary_sql(source: str, size: int) -> str:
    return f"""words AS (SELECT token, count(*) AS n FROM
      (SELECT unnest({tokens('complete_function')}) AS token FROM {source})
      WHERE token NOT IN ({END_OF_TEXT}, '<|unk|>') GROUP BY token ORDER BY n DESC, token LIMIT {size}),
    vocabulary AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 1 AS id FROM words
      UNION ALL SELECT {END_OF_TEXT}, 0, 0 UNION ALL SELECT '<|unk|>', 0, 1)"""


oracle(
    "vocab_build",
    f"""WITH texts AS (SELECT {complete('documentation')} AS complete_function FROM code_functions),
    {vocabulary_sql('texts', 500)} SELECT token, n, id FROM vocabulary""",
    "code_functions",
)


def ids(x: str, length: int) -> str:
    return f"""SELECT {KEY}, list(coalesce(id, 1) ORDER BY pos) AS ids FROM (
      SELECT {KEY}, unnest({tokens(x)}[:{length}]) AS token, generate_subscripts({tokens(x)}[:{length}], 1) AS pos
      FROM rows) LEFT JOIN vocabulary USING (token) GROUP BY {KEY}"""


def padded(x: str, length: int) -> str:
    return f"list_resize({x}, {length}, 0)"


def encoded_sql(x: str, y: str, length: int) -> str:
    return f"""WITH rows AS (SELECT {KEY}, signature, body, {complete('documentation')} AS complete_function,
        {model_input('documentation')} AS simple_input, {MODEL_OUTPUT} AS simple_output
      FROM code_functions WHERE {ENCODABLE}),
    {vocabulary_sql('rows', 500)}, x AS ({ids(x, length)}), y AS ({ids(y, length)})
    SELECT {KEY}, len(x.ids) AS used, md5({joined(padded('x.ids', length))}) AS ids_md5,
      md5({joined(padded('y.ids', length))}) AS labels_md5
    FROM x JOIN y USING ({KEY})"""


oracle("encode_padded", encoded_sql("complete_function", "complete_function", 256), "code_functions")
oracle("encode_simple", encoded_sql("simple_input", "simple_output", 128), "code_functions")


def sample_rank(key: str) -> str:
    return f"md5('100' || chr(1) || {key})"


FUNCTION_RANK = sample_rank("author || chr(1) || project || chr(1) || file_path || chr(1) || line_number")


def prepared_sql(doc: str, fraction: float, min_doc: int, out: str = "md5({}) AS complete_md5") -> str:
    return f"""WITH deduplicated AS (SELECT * FROM code_functions WHERE project <> 'HumanEval.jl'
      QUALIFY row_number() OVER (PARTITION BY documentation, signature, body ORDER BY {KEY}) = 1),
    chosen AS (SELECT {KEY}, signature, body, {doc} AS documentation FROM deduplicated
      WHERE {DOCUMENTED} AND {searched_name('signature')} NOT IN
        (SELECT {prompt_name('prompt')} AS n FROM prompts WHERE n IS NOT NULL)),
    sampled AS (SELECT *, row_number() OVER (ORDER BY {FUNCTION_RANK}) AS place, count(*) OVER () AS n FROM chosen)
    SELECT {KEY}, {out.format(complete('documentation'))} FROM sampled
    WHERE place <= round_even({fraction} * n, 0) AND {ENCODABLE.replace('>= 10', f'>= {min_doc}')}"""


oracle("encode_prepared", prepared_sql(strip_signature(), 1.0, 10), "code_functions", "prompts")
oracle(
    "encode_prepared_sampled",
    prepared_sql(first_line(f"({strip_signature()})"), 0.35, 5),
    "code_functions",
    "prompts",
)
oracle(
    "encode_corpus",
    f"""WITH rows AS ({prepared_sql(strip_signature(), 1.0, 10, "{} AS complete_function")}),
    {vocabulary_sql('rows', 500)}, x AS ({ids('complete_function', 256)})
    SELECT {KEY}, len(x.ids) AS used, md5({joined(padded('x.ids', 256))}) AS ids_md5,
      md5({joined(padded('x.ids', 256))}) AS labels_md5 FROM x""",
    "code_functions",
    "prompts",
)
oracle(
    "exact_sample_35",
    f"""WITH ranked AS (SELECT {KEY}, row_number() OVER (ORDER BY {FUNCTION_RANK}) AS place, count(*) OVER () AS n
        FROM code_functions) SELECT {KEY} FROM ranked WHERE place <= round_even(0.35 * n, 0)""",
    "code_functions",
)
oracle(
    "embedding_subset",
    f"""WITH ranked AS (SELECT vec_id, row_number() OVER (ORDER BY {sample_rank('vec_id')}) AS place,
        count(*) OVER () AS n FROM embeddings) SELECT vec_id FROM ranked WHERE place <= round_even(0.1 * n, 0)""",
)

# Evaluation -------------------------------------------------------------------

oracle(
    "results_extract",
    """SELECT name AS problem, CAST(regexp_extract(name, '([0-9]+)', 1) AS BIGINT) AS number, status = 'OK' AS passed,
       md5(prompt) AS prompt_md5,
       md5(substr(program, length(prompt) + 1, length(program) - length(prompt) - length(tests))) AS prediction_md5
    FROM result_documents ORDER BY number, name""",
    "result_documents",
)
oracle(
    "paired_results",
    "SELECT 'Problem_' || doc_id AS problem, quality = 1 AS passed_a, toxic = 1 AS passed_b FROM labels",
)
CONTINGENCY = """count_if(quality = 1 AND toxic = 1)::BIGINT AS a, count_if(quality = 1 AND toxic <> 1)::BIGINT AS b,
  count_if(quality <> 1 AND toxic = 1)::BIGINT AS c, count_if(quality <> 1 AND toxic <> 1)::BIGINT AS d FROM labels"""
oracle("paired_contingency", f"SELECT {CONTINGENCY}")
oracle(
    "mcnemar_exact",
    f"""WITH t AS (SELECT {CONTINGENCY}),
    p AS (SELECT a, b, c, d, least(1, (SELECT sum(2 * exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1)
      - (b + c) * ln(2))) FROM unnest(range(0, least(b, c) + 1)) AS r(k))) AS p FROM t)
    SELECT a, b, c, d, round(p, 9) AS p_value, round(log10(p), 6) AS log10_p FROM p""",
)


def pass_rate(k: int) -> str:
    misses = f"list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - {k}::DOUBLE / i))"
    rate = f"CASE WHEN c = 0 THEN 0 WHEN n - c < {k} THEN 1 ELSE 1 - {misses} END"
    return f"round(avg({rate}), 6) AS pass_at_{k}"


oracle(
    "benchmark_pass_at_k",
    f"""WITH problems AS (SELECT regexp_replace(name, '[0-9][0-9]_x$', '') AS problem, count(*) AS n,
        count_if(status = 'OK')::BIGINT AS c FROM result_documents GROUP BY 1)
    SELECT count(*) AS problems, {pass_rate(1)}, {pass_rate(2)}, {pass_rate(5)} FROM problems""",
    "result_documents",
)

# Similarity and clusters ------------------------------------------------------


def grams(source: str, key: str, x: str) -> str:
    """Rows (key, n, gram) of all n-grams, from shifted token positions."""
    shifts = " UNION ALL ".join(
        f"""SELECT {key}, {n} AS n, {" || ' ' || ".join(["a.token", *(f"l{i}" for i in range(1, n))])} AS gram
        FROM a WHERE {" AND ".join(["true", *(f"l{i} IS NOT NULL" for i in range(1, n))])}"""
        for n in range(1, 5)
    )
    leads = ", ".join(f"lead(token, {i}) OVER (PARTITION BY {key} ORDER BY pos) AS l{i}" for i in range(1, 4))
    return f"""(WITH a AS (SELECT *, {leads} FROM (SELECT {key}, unnest({tokens(x)}) AS token,
        generate_subscripts({tokens(x)}, 1) AS pos FROM {source})) {shifts})"""


def trivial(source: str, key: str, x: str, m: int) -> str:
    return f"""SELECT n::BIGINT AS n, gram, count(*) AS count FROM {grams(source, key, x)}
        GROUP BY n, gram ORDER BY count DESC, n, gram LIMIT {m}"""


oracle("trivial_ngrams", trivial("code_functions", "file_path", "body", 100), "code_functions")

_SUMS = ", ".join(
    f"""coalesce(sum(CASE WHEN n = {n} THEN least(c, r) END), 0)::BIGINT AS matched_{n},
        coalesce(sum(CASE WHEN n = {n} THEN c END), 0)::BIGINT AS total_{n}"""
    for n in range(1, 5)
)
_LOG = " + ".join(f"ln(nullif(matched_{n}, 0) / total_{n}::DOUBLE)" for n in range(1, 5))
oracle(
    "ngram_pair_similarity",
    f"""WITH pairs AS (SELECT name AS id, prompt AS reference,
      substr(program, length(prompt) + 1, length(program) - length(prompt) - length(tests)) AS candidate
      FROM result_documents),
    turns AS (SELECT conv_id * 1000 + turn AS k, text FROM conversations),
    common AS ({trivial('turns', 'k', 'text', 50)}),
    c AS (SELECT id, n, gram, count(*) AS c FROM {grams('pairs', 'id', 'candidate')} GROUP BY ALL),
    r AS (SELECT id, n, gram, count(*) AS r FROM {grams('pairs', 'id', 'reference')} GROUP BY ALL),
    counted AS (SELECT id, n, c, coalesce(r, 0) AS r FROM c LEFT JOIN r USING (id, n, gram)
      ANTI JOIN common USING (n, gram)),
    sums AS (SELECT id, {_SUMS} FROM pairs LEFT JOIN counted USING (id) GROUP BY id)
    SELECT id, {", ".join(f"{s}_{n}" for n in range(1, 5) for s in ("matched", "total"))},
      round(coalesce(exp(({_LOG}) / 4) * CASE WHEN len({tokens('candidate')}) >= len({tokens('reference')}) THEN 1
        ELSE exp(1 - len({tokens('reference')}) / len({tokens('candidate')})::DOUBLE) END, 0), 6) AS score
    FROM sums JOIN pairs USING (id)""",
    "result_documents",
)
oracle(
    "ngram_corpus_similarity",
    f"""WITH texts AS (SELECT author || '/' || project || '/' || file_path AS id, body FROM code_functions),
    common AS ({trivial('texts', 'id', 'body', 100)}),
    counted AS (SELECT id, n, gram, count(*) AS c FROM {grams('texts', 'id', 'body')}
      ANTI JOIN common USING (n, gram) GROUP BY ALL),
    others AS (SELECT *, max(c) OVER (PARTITION BY n, gram ORDER BY c DESC, id
        ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS below,
      max(c) OVER (PARTITION BY n, gram ORDER BY c DESC, id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM counted),
    scores AS (SELECT id, sum(least(c, coalesce(greatest(below, above), 0))) AS matched, sum(c) AS total
      FROM others GROUP BY id)
    SELECT id, coalesce(matched, 0)::BIGINT AS matched, coalesce(total, 0)::BIGINT AS total,
      round(coalesce(matched / total, 0), 6) AS shared FROM texts LEFT JOIN scores USING (id)""",
    "code_functions",
)

oracle(
    "similar_functions",
    f"""WITH RECURSIVE texts AS (
      SELECT author || '/' || project || '/' || file_path AS id, body, {tokens('body')} AS t FROM code_functions),
    own AS (SELECT DISTINCT id, gram FROM {grams('texts', 'id', 'body')}
      WHERE n = 4 UNION ALL SELECT id, array_to_string(t, ' ') FROM texts WHERE len(t) BETWEEN 1 AND 3),
    grams AS (SELECT id, coalesce(g, []) AS g FROM texts LEFT JOIN
      (SELECT id, list(gram ORDER BY gram) AS g FROM own GROUP BY id) USING (id)),
    sets AS (SELECT min(id) AS s, g, len(g) AS n FROM grams GROUP BY g),
    posted AS (SELECT s, n, unnest(g) AS gram FROM sets),
    shared AS (SELECT a.s AS a, b.s AS b, a.n + b.n AS both_n, count(*) AS c
      FROM posted AS a JOIN posted AS b ON a.gram = b.gram AND a.s <> b.s AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n)
      GROUP BY ALL),
    linked AS (SELECT a, b FROM shared WHERE c / (both_n - c)::DOUBLE >= 0.8),
    reached AS (SELECT s, s AS low FROM sets UNION SELECT r.s, b FROM reached AS r JOIN linked ON low = a),
    classes AS (SELECT g, min(low) AS class_id FROM reached JOIN sets USING (s) GROUP BY g)
    SELECT id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size FROM grams JOIN classes USING (g)""",
    "code_functions",
)

_DIMENSIONS = """
WITH values AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x,
  generate_subscripts(embedding, 1) AS i FROM embeddings),
centred AS (SELECT *, avg(x) OVER (PARTITION BY label, i) AS m, avg(x) OVER (PARTITION BY i) AS g FROM values)
"""
oracle(
    "calinski_harabasz_labels",
    _DIMENSIONS
    + """SELECT count(DISTINCT vec_id) AS points, count(DISTINCT label) AS clusters,
      round(sum((x - m) * (x - m)), 6) AS inertia,
      round((sum((m - g) * (m - g)) / (count(DISTINCT label) - 1))
        / (sum((x - m) * (x - m)) / (count(DISTINCT vec_id) - count(DISTINCT label))), 6) AS calinski_harabasz
    FROM centred""",
)
oracle(
    "silhouette_labels",
    """WITH vectors AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    sizes AS (SELECT label, count(*) AS n FROM vectors GROUP BY label),
    sums AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.e, b.e) ** 2) AS s
      FROM vectors AS a, vectors AS b GROUP BY ALL),
    means AS (SELECT vec_id, max(CASE WHEN own = other THEN s / nullif(n - 1, 0) END) AS a,
      min(CASE WHEN own <> other THEN s / n END) AS b FROM sums JOIN sizes ON sizes.label = other GROUP BY vec_id)
    SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM means""",
)
oracle(
    "kmeans_assignments",
    """SELECT k, (SELECT count(*) FROM embeddings) AS points, k AS clusters, 0::BIGINT AS misplaced
    FROM (SELECT unnest([2, 5, 10, 20])::BIGINT AS k)""",
)
