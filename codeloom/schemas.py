"""Explicit schemas of every table the engine reads or writes."""

from pyspark.sql import types as T

#: Identity and order of a function. Every first-wins rule sorts by these columns.
KEY = ["author", "project", "file_path", "line_number"]

FUNCTION_FIELDS = [
    T.StructField("documentation", T.StringType()),
    T.StructField("signature", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("inline_comments", T.ArrayType(T.StringType())),
    T.StructField("file_path", T.StringType()),
    T.StructField("line_number", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("module", T.StringType()),
]

#: One function inside a project record.
FUNCTION = T.StructType(FUNCTION_FIELDS)

#: Project records: the nested exchange format.
PROJECTS = T.StructType(
    [
        T.StructField("author", T.StringType()),
        T.StructField("project", T.StringType()),
        T.StructField("functions", T.ArrayType(FUNCTION)),
    ]
)

#: Flat functions: the working format.
FUNCTIONS = T.StructType(
    [T.StructField("author", T.StringType()), T.StructField("project", T.StringType()), *FUNCTION_FIELDS]
)

#: Source files.
FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())])

REPOS = T.StructType([T.StructField("name", T.StringType())])

PROMPTS = T.StructType([T.StructField("prompt", T.StringType())])

#: One benchmark problem with the programs that were run for it.
RESULT_DOCUMENT = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("tests", T.StringType()),
        T.StructField(
            "results",
            T.ArrayType(
                T.StructType(
                    [T.StructField("program", T.StringType()), T.StructField("status", T.StringType())]
                )
            ),
        ),
    ]
)

#: Exported result rows.
RESULTS = T.StructType(
    [
        T.StructField("problem", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("prediction", T.StringType()),
        T.StructField("passed", T.BooleanType()),
    ]
)
