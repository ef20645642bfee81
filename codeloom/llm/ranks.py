"""Places of rows in a global order, without a task that sees a whole group.

Rows are dealt to ranges of the order and numbered within their range. A group
that starts in an earlier range goes on from the rows that it has there; one
number for each range says from where, so a group may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.session import materialize

#: Columns that are added while rows are numbered.
PART, NEAR, FIRST = "__part__", "__near__", "__first__"


def ranked(df: DataFrame, group: str, *order: str, name: str = "ranked") -> DataFrame:
    """``df`` with ``rank``, a long from 0 within each group, in a written table.

    Nulls are a group and come first. Rows that tie are told apart by their place
    in the partitions of ``df``, which is arbitrary, so ties should be rows that
    no one can tell apart. ``df`` should be a written table: it is read twice.
    """
    key, tie = "__group__", "__tie__"
    given = df.withColumn(tie, F.monotonically_increasing_id())
    dealt = given.repartitionByRange(group, *order, tie).sortWithinPartitions(group, *order, tie).drop(tie)
    named = dealt.withColumn(key, F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")))
    schema = T.StructType([*named.schema, T.StructField(NEAR, T.LongType()), T.StructField(FIRST, T.BooleanType())])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, near, first = None, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(key))
            new = np.ones(batch.num_rows, bool)
            new[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
            new[0] = last is not None and keys[0].as_py() != last
            at = np.arange(batch.num_rows)
            start = np.maximum.accumulate(np.where(new, at, -1))
            place = np.where(start >= 0, at - start, at + near)
            in_first = first & (start < 0)
            last, near, first = keys[-1].as_py(), int(place[-1]) + 1, bool(in_first[-1])
            cells = [*batch.columns, pa.array(place, pa.int64()), pa.array(in_first)]
            yield pa.RecordBatch.from_arrays(cells, names=[*batch.schema.names, NEAR, FIRST])

    placed = named.mapInArrow(numbered, schema).withColumn(PART, F.spark_partition_id())
    placed = materialize(placed, name)
    # One row for each range: its first group, its last one, and the rows of that; as many as there are partitions.
    end = F.struct(key, (F.col(NEAR) + 1).alias("rows"), FIRST)
    ranges = placed.groupBy(PART).agg(
        F.min_by(key, F.struct(~F.col(FIRST), NEAR)).alias("first"),
        F.max_by(end, F.struct(~F.col(FIRST), group, NEAR)).alias("end"),
    )
    before, carried, last = [], 0, None
    for r in ranges.orderBy(PART).collect():
        start = carried if r["first"] == last else 0
        before.append((r[PART], start))
        last, carried = r["end"][key], r["end"]["rows"] + (start if r["end"][FIRST] else 0)
    starts = df.sparkSession.createDataFrame(before, f"`{PART}` int, start long")
    rank = F.col(NEAR) + F.when(F.col(FIRST), F.col("start")).otherwise(0)
    return placed.join(F.broadcast(starts), PART).withColumn("rank", rank).drop(PART, NEAR, FIRST, key, "start")
