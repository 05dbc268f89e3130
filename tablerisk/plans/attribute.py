"""Attribute audit: how well do count answers reveal a target's sensitive value?"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import asdict
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerisk.functions.durable import checkpoint_folder, durable
from tablerisk.functions.keyed import mix_int
from tablerisk.operators.metrics import binary_metrics
from tablerisk.operators.models import grouped_fits
from tablerisk.operators.overlay import Overlay, exact_overlay
from tablerisk.operators.prep import value_groups
from tablerisk.operators.sampling import dataset_ids
from tablerisk.operators.shadow import auxiliary_shadow, target_dataset
from tablerisk.plans.answer_store import AnswerStore, answer_matrix, dataset_labels, formatted, members_table
from tablerisk.plans.query_search import SearchConfig, query_search
from tablerisk.sources.results import resume_targets, run_key, write_results
from tablerisk.spec import ID, Mechanism

PARALLEL_TARGETS = 4

# Display names of the two final models and their fits.
FINAL_MODELS = {"logreg": "logreg", "mlp": "mlp"}
PREDICTIONS = ("target_id", "model", "phase", "dataset_id", "label", "probability", "asked")


def choose_targets(test: DataFrame, columns: Sequence[str], n: int) -> list[int]:
    """The first ``n`` records (by id) whose attribute values are unique in the test split.

    Where a large split has no unique record, the rarest attribute values are audited, by the smallest id that has them:
    the datasets hold no other record equal to the target in either case.
    """
    groups = durable(value_groups(test.filter(F.col(ID).isNotNull()), columns))
    least = groups.agg(F.min("n").alias("n"))  # one row
    return [r[0] for r in groups.join(F.broadcast(least), "n").orderBy(ID).select(ID).limit(n).collect()]


def audit_one_target(
    split: DataFrame,
    columns: Sequence[str],
    target_id: int,
    mechanism: Mechanism,
    scenario: str,
    config: SearchConfig,
    n_rows: int,
    n_datasets: int,
    n_tests: int,
    folder: str | None = None,
) -> DataFrame:
    """Search, train the final models, test them on fresh target datasets -> predictions.

    ``asked`` is the number of queries that were put to each shadow dataset's interface. What the search has stored under
    ``folder`` is continued.

    ``split`` holds record_id, integer columns and split in {test, aux}. In the "auxiliary"
    scenario shadow datasets come from aux; in the "exact" one they are the target dataset itself
    with only the target's sensitive value redrawn. Test datasets use other noise seeds.
    """
    columns = list(columns)
    rows = split.select(ID, *columns, "split")
    test = rows.filter("split = 'test'").drop("split")
    target = durable(test.filter(F.col(ID) == F.lit(target_id)).distinct())  # a row given twice is one record
    seed = mix_int(mix_int(config.seed + 1) + target_id % (1 << 31) + 1) % (1 << 30)
    spark = split.sparkSession
    asked = [*columns, "sensitive"]
    if scenario == "auxiliary":
        aux = rows.filter("split = 'aux'").drop("split")
        shadows = durable(auxiliary_shadow(aux, target, columns, n_rows, n_datasets, seed))
        tests = target_dataset(test, target, columns, n_rows, dataset_ids(spark, n_tests), seed + 1)
        tests = durable(tests.withColumn("phase", F.lit("test")))
    elif scenario == "exact":
        fixed = target_dataset(test, target, columns, n_rows, dataset_ids(spark, 1), seed + 1)
        fixed = durable(fixed.drop("dataset_id"))
        # one table and a bit a dataset: the target's value is all that differs
        phase = F.when(F.col("dataset_id") < n_datasets // 2, "train").otherwise("eval")
        shadows = exact_overlay(fixed, n_datasets, seed + 2, target_id)
        shadows = Overlay(fixed, durable(shadows.deltas.withColumn("phase", phase)))
        tests = exact_overlay(fixed, n_tests, seed + 3, target_id)
        # half of the test datasets carry each value of the sensitive bit
        balanced = F.when(F.col("weight") == 1, (F.col("dataset_id") % 2).cast("int")).otherwise(F.col("sensitive"))
        deltas = tests.deltas.withColumn("sensitive", balanced).withColumn("phase", F.lit("test"))
        tests = Overlay(fixed, durable(deltas))
    else:
        raise ValueError(f"unknown scenario {scenario!r}")
    found = query_search(shadows, asked, target, target_id, mechanism, config, folder and f"{folder}/search")
    best = formatted(found.population[0], mechanism)
    members = members_table(spark, [best])
    unseen = AnswerStore(tests, asked, target, mechanism, seed + 4, folder and f"{folder}/tests")
    unseen.update(set(best))
    parts = [
        answer_matrix(members, store.answers(members), dataset_labels(tables, target_id))
        for store, tables in ((found.store, shadows), (unseen, tests))
    ]
    matrix = parts[0].unionByName(parts[1]).drop("solution_id")
    matrix = matrix.withColumn("target_id", F.lit(target_id).cast("bigint"))
    scored = grouped_fits(matrix, ["target_id"], FINAL_MODELS, config.seed)
    return scored.withColumn("asked", F.lit(found.store.asked).cast("bigint")).select(*PREDICTIONS)


def attribute_predictions(
    split: DataFrame,
    columns: Sequence[str],
    targets: Sequence[int],
    mechanism: Mechanism,
    scenario: str = "auxiliary",
    config: SearchConfig | None = None,
    n_rows: int = 1000,
    n_datasets: int = 1000,
    n_tests: int = 500,
    folder: str | None = None,
) -> DataFrame:
    """Predictions for several targets, stored target by target -> target_id, model, phase, dataset_id, label, ...

    Results lie under ``folder`` in a directory named after the parameters. A target with stored predictions is not
    audited again, and one whose audit was cut off continues from its last generation. ``split`` must be the same table.
    """
    config = config or SearchConfig()
    if not targets:
        raise ValueError("no targets")
    spark = split.sparkSession
    parameters = {
        "columns": list(columns), "mechanism": asdict(mechanism), "scenario": scenario, "config": asdict(config),
        "n_rows": n_rows, "n_datasets": n_datasets, "n_tests": n_tests,
    }
    folder = folder or f"{checkpoint_folder(spark).rstrip('/')}/attribute-{uuid.uuid4()}"
    run = f"{folder.rstrip('/')}/{run_key(parameters)}"
    wanted = spark.createDataFrame([(t,) for t in targets], "target_id bigint").distinct()
    missing = resume_targets(wanted, f"{run}/predictions", "target_id")
    todo = sorted(r["target_id"] for r in missing.collect())  # some of the given targets

    def audit(target_id: int) -> None:
        scored = audit_one_target(
            split, columns, target_id, mechanism, scenario, config, n_rows, n_datasets, n_tests, f"{run}/{target_id}"
        )
        write_results(scored, f"{run}/predictions", ["target_id"])

    # searches for different targets are independent: their jobs share the cluster
    if todo:
        with ThreadPool(min(PARALLEL_TARGETS, len(todo))) as threads:
            threads.map(audit, todo)
    stored = spark.read.parquet(f"{run}/predictions").withColumn("target_id", F.col("target_id").cast("bigint"))
    return stored.join(wanted, "target_id", "left_semi").select(*PREDICTIONS)


def attribute_audit(
    split: DataFrame, columns: Sequence[str], targets: Sequence[int], mechanism: Mechanism, *args, **options
) -> DataFrame:
    """Audit several targets -> target_id, model, acc_train, acc_eval, acc_test, auc_test, asked.

    Takes the arguments of ``attribute_predictions``.
    """
    scored = attribute_predictions(split, columns, targets, mechanism, *args, **options)
    metrics = binary_metrics(scored, ["target_id", "model", "phase"], strict=False)
    at = {p: F.max(F.when(F.col("phase") == p, F.col("accuracy"))) for p in ("train", "eval", "test")}
    out = metrics.groupBy("target_id", "model").agg(
        *[value.alias(f"acc_{p}") for p, value in at.items()],
        F.max(F.when(F.col("phase") == "test", F.col("auc"))).alias("auc_test"),
    )
    asked = scored.groupBy("target_id").agg(F.max("asked").alias("asked"))
    return out.join(asked, "target_id")
