"""Exact seeded sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.schemas import KEY

SEED = 100

#: Hex digits of the histogram bucket: 16**5 buckets, so the one bucket that is
#: sorted holds a millionth of the rows.
BUCKET_DIGITS = 5


def exact_sample(df: DataFrame, fraction: float, seed: int = SEED, key: list[str] = KEY) -> DataFrame:
    """Exactly ``round(fraction * n)`` rows, halves rounded to even.

    Rows are ranked by a seeded hash of their key. Sorting all rows for a limit
    would end in one task, so the limit is turned into a threshold: a histogram
    of hash prefixes tells which bucket holds the last sampled row, only that
    bucket is ranked, and the sample is then a plain filter.
    """
    if fraction >= 1:
        return df
    rank = F.md5(F.concat_ws("\u0001", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    hashed = df.withColumn("_rank", rank).withColumn("_bucket", F.substring("_rank", 1, BUCKET_DIGITS))

    # At most 16**5 small rows from here to the threshold.
    histogram = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"))
    wanted = F.bround(F.sum("n").over(Window.partitionBy()) * F.lit(fraction)).cast("bigint")
    seen = F.sum("n").over(Window.orderBy("_bucket"))
    last = (
        histogram.select("_bucket", "n", wanted.alias("wanted"), seen.alias("seen"))
        .where("seen >= wanted and seen - n < wanted")
        .select(F.struct("_bucket", (F.col("wanted") - F.col("seen") + F.col("n")).alias("missing")))
        .scalar()
    )

    place = F.struct("_rank", *key)
    threshold = (
        hashed.where(F.col("_bucket") == last["_bucket"])
        .select(place.alias("place"))
        .withColumn("nth", F.row_number().over(Window.orderBy("place")))
        .where(F.col("nth") == last["missing"])
        .select("place")
        .scalar()
    )
    # Without a threshold, as for a fraction that rounds to zero rows, nothing passes.
    return hashed.where(place <= threshold).drop("_rank", "_bucket")
