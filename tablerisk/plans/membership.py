"""Membership audit: can an attacker tell that a record was in a synthesised table's source?"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerisk.functions.durable import checkpoint_folder, durable
from tablerisk.operators.features import (
    drop_zero_features,
    extract_features,
    feature_vectors,
    standardize_features,
)
from tablerisk.operators.metrics import binary_metrics
from tablerisk.operators.models import fit_models
from tablerisk.operators.shadow import (
    shadow_tables,
    shadow_tables_average,
    shadow_tables_specific,
    target_numbers,
)
from tablerisk.operators.synthesis import synthesize
from tablerisk.sources.results import resume_targets, run_key, write_results
from tablerisk.spec import ID, TableSpec

PARALLEL_TARGETS = 4
TARGETS_AT_ONCE = 20
PHASES = ("train", "average", "specific")
PHASE_KEYS = ("target_id", "phase", "dataset_id")
PREDICTIONS = (*PHASE_KEYS, "label", "model", "probability")


def attack_vectors(
    split: DataFrame,
    spec: TableSpec,
    targets: DataFrame,
    synthesizer: str = "synthpop",
    n_original: int = 1000,
    n_synth: int = 1000,
    n_datasets: int = 1000,
    n_eval: int | None = None,
    epsilon: float | None = None,
    evaluations: Sequence[str] = ("specific",),
    extractors: Sequence | None = None,
    seed: int = 0,
) -> DataFrame:
    """Features of the synthesised tables of all these targets -> target_id, phase, dataset_id, label, features.

    ``targets`` carry their number among all targets. The shadow tables of every target and phase are built, synthesised
    and turned into features together, as one long table in a fixed number of jobs.
    """
    n_eval = n_datasets if n_eval is None else n_eval
    columns = [ID, *spec.columns]
    aux, pool, base = (split.filter(F.col("split") == name).select(*columns) for name in ("aux", "eval", "target"))
    parts = {"train": shadow_tables(aux, targets, n_original, n_datasets, seed)}
    if "average" in evaluations:
        parts["average"] = shadow_tables_average(pool, targets, n_original, n_eval, seed + 1)
    if "specific" in evaluations:
        parts["specific"] = shadow_tables_specific(base, targets, pool, n_eval, seed + 2)
    # one running number per (target, phase, dataset) keys the synthesizer: the phases' numbers take turns
    tables = None
    for place, (phase, part) in enumerate(parts.items()):
        number = (F.col("dataset_id") * len(PHASES) + PHASES.index(phase)).cast("bigint")
        part = part.select("target_id", F.lit(phase).alias("phase"), number.alias("dataset_id"), "in_dataset", *columns)
        tables = part if place == 0 else tables.unionByName(part)
    tables = durable(tables)
    labels = durable(tables.select(*PHASE_KEYS, F.col("in_dataset").cast("int").alias("label")).distinct())
    made = synthesize(tables.drop("target_id", "phase", "in_dataset"), spec, synthesizer, n_synth, seed, epsilon)
    made = durable(made.join(labels.drop("label"), "dataset_id").withColumnRenamed("row_no", ID))
    if extractors is None:
        orders = tuple(range(1, len(spec.columns) + 1))
        extractors = [("query", orders, None, (1,), (3,))]
    features = durable(extract_features(made, spec, targets.select(*columns), extractors, PHASE_KEYS))
    train, rest = features.filter("phase = 'train'"), features.filter("phase <> 'train'")
    train, rest = drop_zero_features(train, rest)
    train, rest = standardize_features(train, rest)
    return feature_vectors(train.unionByName(rest), PHASE_KEYS).join(labels, list(PHASE_KEYS))


def membership_predictions(
    split: DataFrame,
    spec: TableSpec,
    targets: DataFrame,
    models: Sequence[str] = ("random_forest",),
    cv: bool = False,
    params: dict | None = None,
    seed: int = 0,
    folder: str | None = None,
    **tables,
) -> DataFrame:
    """Attack predictions -> target_id, phase, dataset_id, label, model, probability.

    ``split`` is the prepared table with its ``split`` column (aux / target / eval); ``targets`` are chosen records of it
    outside aux, any number of them. Rounds of at most TARGETS_AT_ONCE targets share all jobs but the model fits, and store
    their predictions (of the train tables, too) under ``folder``, in a directory named after the parameters. Targets with stored predictions are not
    audited again, so a job that was cut off goes on with the first round it lacks. ``tables`` are the options of ``attack_vectors``.
    """
    spark = split.sparkSession
    columns = [ID, *spec.columns]
    split = split.select(*columns, "split")
    chosen = durable(targets.select(*columns))
    if chosen.isEmpty():
        raise ValueError("no targets")
    aux = split.filter("split = 'aux'")
    if aux.join(chosen.select(ID), ID, "left_semi").limit(1).count():
        raise ValueError("targets must not be auxiliary records")
    chosen = durable(chosen.join(target_numbers(chosen), ID))
    parameters = {"columns": columns, "models": list(models), "cv": cv, "params": params, "seed": seed, **tables}
    folder = folder or f"{checkpoint_folder(spark).rstrip('/')}/membership-{uuid.uuid4()}"
    path = f"{folder.rstrip('/')}/{run_key(parameters)}"
    while True:
        left = resume_targets(chosen.withColumn("target_id", F.col(ID)), path, "target_id")
        ids = [r[0] for r in left.select(ID).orderBy(ID).limit(TARGETS_AT_ONCE).collect()]  # one round
        if not ids:
            break
        audited = chosen.filter(F.col(ID).isin(ids))
        vectors = durable(attack_vectors(split, spec, audited, seed=seed, **tables))

        def fit(target: int) -> None:
            mine = vectors.filter(F.col("target_id") == target)
            train = mine.filter("phase = 'train'")
            key = "dataset_id" if cv else None
            scored = fit_models(train, mine, models, cv_key=key, seed=seed, params=params)
            write_results(scored.select(*PREDICTIONS), path, ["target_id"])

        # the fits of different targets are independent Spark jobs
        with ThreadPool(min(PARALLEL_TARGETS, len(ids))) as threads:
            threads.map(fit, ids)
    stored = spark.read.parquet(path).withColumn("target_id", F.col("target_id").cast("bigint"))
    return stored.join(chosen.select(F.col(ID).alias("target_id")), "target_id", "left_semi").select(*PREDICTIONS)


def membership_audit(split: DataFrame, spec: TableSpec, targets: DataFrame, **options) -> DataFrame:
    """Quality of the membership attack -> record_id, evaluation, model, auc, accuracy.

    The evaluation "train" is the attack's quality on the tables it was fitted on. Takes the options of
    ``membership_predictions``.
    """
    predictions = membership_predictions(split, spec, targets, **options)
    metrics = binary_metrics(predictions, ["target_id", "phase", "model"])
    return metrics.select(
        F.col("target_id").alias("record_id"),
        F.col("phase").alias("evaluation"),
        "model",
        "auc",
        "accuracy",
    )
