"""k-means over embeddings and its quality figures."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values -----------------------------------------------------------------

CLUSTER_COUNTS = range(2, 21)

# ------------------------------------------------------------------------------


def as_vectors(df: DataFrame, column: str = "embedding", out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(column).cast("array<double>")))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dispersion(df: DataFrame, label: str = "prediction", features: str = "features") -> DataFrame:
    """``(points, clusters, inertia, calinski_harabasz)`` of given assignments, one row.

    Mean and variance per cluster come from one aggregate that is combined per
    task; one row per cluster is left for the rest.
    """
    per_cluster = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"),
        vector_to_array(Summarizer.mean(F.col(features))).alias("mean"),
        vector_to_array(Summarizer.variance(F.col(features))).alias("variance"),
    )
    # Centre of all points as a weighted sum of the means, one array per row.
    weighted = per_cluster.select(
        "n", "mean", (_total(F.col("variance")) * (F.col("n") - 1)).alias("within")
    )
    centre = (
        weighted.select(F.posexplode("mean").alias("i", "x"), "n")
        .groupBy("i")
        .agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"))
        .agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c"))
        .select(F.transform("c", lambda r: r["x"]))
        .scalar()
    )
    gap = F.zip_with("mean", "centre", lambda m, c: (m - c) * (m - c))
    totals = weighted.withColumn("centre", centre).agg(
        F.sum("n").alias("points"),
        F.count(F.lit(1)).alias("clusters"),
        F.sum("within").alias("inertia"),
        F.sum(F.col("n") * _total(gap)).alias("between"),
    )
    k, n = F.col("clusters"), F.col("points")
    score = (F.col("between") / F.nullif(k - 1, F.lit(0))) / (
        F.nullif(F.col("inertia"), F.lit(0.0)) / F.nullif(n - k, F.lit(0))
    )
    return totals.select("points", "clusters", "inertia", score.alias("calinski_harabasz"))


def silhouette(df: DataFrame, label: str = "prediction", features: str = "features") -> float:
    """Mean silhouette with squared Euclidean distance; linear in the points."""
    return ClusteringEvaluator(predictionCol=label, featuresCol=features).evaluate(df)


def kmeans_sweep(
    df: DataFrame,
    ks=CLUSTER_COUNTS,
    seed: int = 1,
    max_iter: int = 20,
    parallelism: int = 8,
    features: str = "features",
) -> DataFrame:
    """One row per ``k``: inertia, silhouette and Calinski-Harabasz index.

    Each fit and score is its own set of Spark jobs over the cached vectors; a
    few run at a time to fill the cluster.
    """
    spark = df.sparkSession
    vectors = df.select(features).cache()

    def fit(k: int):
        model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol=features).fit(vectors)
        assigned = model.transform(vectors)
        row = dispersion(assigned, features=features).first()
        return (
            k,
            float(model.summary.trainingCost),
            float(silhouette(assigned, features=features)),
            float(row["calinski_harabasz"]) if row["calinski_harabasz"] is not None else None,
        )

    try:
        with ThreadPoolExecutor(parallelism) as pool:
            rows = list(pool.map(fit, ks))
    finally:
        vectors.unpersist()
    return spark.createDataFrame(rows, "k int, inertia double, silhouette double, calinski_harabasz double")


def kmeans_checks(
    df: DataFrame, k: int, seed: int = 1, max_iter: int = 20, features: str = "features"
) -> DataFrame:
    """``(k, points, clusters, misplaced)`` of one fit: what must hold for any seed.

    ``misplaced`` counts points that have a nearer centre than that of their cluster, beyond rounding.
    """
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol=features).fit(df.select(features))

    def distance(centre) -> Column:
        values = F.array(*[F.lit(float(x)) for x in centre])
        return _total(F.zip_with("x", values, lambda a, b: (a - b) * (a - b)))

    gaps = F.array(*[distance(c) for c in model.clusterCenters()])
    placed = (
        model.transform(df.select(features))
        .select("prediction", vector_to_array(F.col(features)).alias("x"))
        .select("prediction", gaps.alias("gaps"))
    )
    own = F.get("gaps", F.col("prediction"))
    return placed.agg(
        F.lit(k).cast("bigint").alias("k"),
        F.count(F.lit(1)).alias("points"),
        F.count_distinct("prediction").alias("clusters"),
        F.count_if(own > F.array_min("gaps") * (1 + 1e-9) + 1e-9).alias("misplaced"),
    )
