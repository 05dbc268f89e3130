"""Accuracy, ranking quality and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCORE_BUCKETS = 1024

# Fixed display names of the models.
MODEL_NAMES = {
    "logistic_regression": "Logistic Regression",
    "random_forest": "Random Forest",
    "mlp": "MLP",
}


def binary_metrics(
    scored: DataFrame,
    groups: Sequence[str],
    score: str = "probability",
    label: str = "label",
    cut: float = 0.5,
    strict: bool = True,
) -> DataFrame:
    """Accuracy at ``cut`` and ROC AUC per group -> groups, accuracy, auc (null for one class).

    Equal scores are merged first; the number of negatives below each score is a running sum inside
    a score band plus the total of the lower bands, so a single huge group is not one task.
    """
    groups = list(groups)
    rows = scored.select(
        *groups, F.col(score).cast("double").alias("__s"), F.col(label).cast("int").alias("__y")
    )
    guess = (F.col("__s") > cut if strict else F.col("__s") >= cut).cast("int")
    counts = rows.groupBy(*groups, "__s").agg(
        F.sum("__y").alias("pos"),
        F.sum(1 - F.col("__y")).alias("neg"),
        F.sum((guess == F.col("__y")).cast("int")).alias("right"),
    )
    summary = counts.groupBy(*groups).agg(
        F.min("__s").alias("lo"),
        F.max("__s").alias("hi"),
        F.sum("pos").alias("n1"),
        F.sum("neg").alias("n0"),
        F.sum("right").alias("n_right"),
    )
    share = F.try_divide(F.col("__s") - F.col("lo"), F.col("hi") - F.col("lo"))
    banded = counts.join(summary.select(*groups, "lo", "hi"), groups).withColumn(
        "band", F.floor(F.coalesce(share, F.lit(0.0)) * SCORE_BUCKETS)
    )
    keys = [*groups, "band"]
    lower = Window.partitionBy(*groups).orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    below_band = (
        banded.groupBy(*keys)
        .agg(F.sum("neg").alias("n"))
        .select(*keys, F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    placed = banded.withColumn("before", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(
        below_band, keys
    )
    wins = F.col("pos") * (F.col("start") + F.col("before") + F.col("neg") / 2)
    area = placed.groupBy(*groups).agg(F.sum(wins).alias("wins"))
    auc = F.try_divide(F.col("wins"), (F.col("n1") * F.col("n0")).cast("double"))
    return summary.join(area, groups).select(
        *groups, (F.col("n_right") / (F.col("n1") + F.col("n0"))).alias("accuracy"), auc.alias("auc")
    )


def audit_results_table(results: DataFrame) -> DataFrame:
    """Nested results (record_id, map model -> struct<auc, accuracy>) as a flat, named table.

    The display name is ``model_name``: column names that differ only in case clash in Spark.
    """
    flat = results.select(
        F.col("record_id").alias("record"), F.explode("metrics").alias("model", "m")
    )
    names = F.create_map(*[F.lit(x) for pair in MODEL_NAMES.items() for x in pair])
    return flat.select("record", "m.auc", "m.accuracy", "model", names[F.col("model")].alias("model_name"))


def nest_results(results: DataFrame) -> DataFrame:
    """(record_id, model, auc, accuracy) -> record_id, metrics map; one entry per model."""
    entry = F.struct("model", F.struct("auc", "accuracy").alias("m"))
    return results.groupBy("record_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("metrics")
    )


def aggregate_targets(results: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean of every metric over the targets, per model."""
    means = [F.avg(m).alias(f"mean_{m}") for m in metrics]
    return results.groupBy("model").agg(F.count(F.lit(1)).alias("n_targets"), *means)


def generation_log(fitness: DataFrame) -> DataFrame:
    """Mean and maximum fitness per generation."""
    return fitness.groupBy("generation").agg(
        F.avg("fitness_train").alias("mean_train"),
        F.max("fitness_train").alias("max_train"),
        F.avg("fitness_eval").alias("mean_eval"),
        F.max("fitness_eval").alias("max_eval"),
    )
