"""Attack classifiers on feature vectors, trained with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerisk.functions.keyed import STREAM_RANK, keyed_hash
from tablerisk.operators.small_models import FITS, scaled

# Fixed parameter grids of the cross-validated variants.
LOGISTIC_C = [1e-6, 1e-5, 1e-4, 0.001, 0.01, 0.1, 1, 10]
FOREST_TREES = [20, 50, 100, 200, 500]
FOREST_DEPTH = [3, 5, 10]
FOREST_LEAF = [3, 5]
MLP_LAYERS = [[100], [200], [100, 100], [200, 200]]
FOLDS = 3


def _prepared(features: DataFrame, label: str) -> DataFrame:
    """features (array) -> vector, label -> double."""
    return features.withColumn("__x", array_to_vector("features")).withColumn(
        "__y", F.col(label).cast("double")
    )


def _fit(estimator, train: DataFrame, grid, key: str | None, seed: int):
    if grid is None:
        return estimator.fit(train)
    # folds by hash of the record key: the same record lands in the same fold on every run
    fold = (keyed_hash(seed, key, STREAM_RANK) % FOLDS).cast("int")
    evaluator = MulticlassClassificationEvaluator(labelCol="__y", metricName="accuracy")
    search = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=grid,
        evaluator=evaluator,
        numFolds=FOLDS,
        foldCol="__fold",
        parallelism=4,
    )
    return search.fit(train.withColumn("__fold", fold)).bestModel


def train_logistic(
    train: DataFrame, label: str = "label", c: float = 0.001, cv_key: str | None = None, seed: int = 0
):
    """L2 logistic regression with inverse strength ``c`` (per summed loss)."""
    n = max(train.count(), 1)
    model = LogisticRegression(
        featuresCol="__x", labelCol="__y", regParam=1.0 / (c * n), standardization=False
    )
    grid = None
    if cv_key:
        grid = ParamGridBuilder().addGrid(model.regParam, [1.0 / (v * n) for v in LOGISTIC_C])
    return _fit(model, _prepared(train, label), grid and grid.build(), cv_key, seed)


def train_forest(
    train: DataFrame, label: str = "label", cv_key: str | None = None, seed: int = 0, trees: int = 100
):
    """Random forest, 100 trees of depth 10."""
    model = RandomForestClassifier(
        featuresCol="__x", labelCol="__y", numTrees=trees, maxDepth=10, seed=seed
    )
    grid = None
    if cv_key:
        grid = (
            ParamGridBuilder()
            .addGrid(model.numTrees, FOREST_TREES)
            .addGrid(model.maxDepth, FOREST_DEPTH)
            .addGrid(model.minInstancesPerNode, FOREST_LEAF)
        )
    return _fit(model, _prepared(train, label), grid and grid.build(), cv_key, seed)


def train_mlp(
    train: DataFrame,
    label: str = "label",
    hidden: Sequence[int] = (100, 100),
    cv_key: str | None = None,
    seed: int = 0,
    max_iter: int = 100,
):
    """Multilayer perceptron. Spark's has sigmoid hidden layers and no L2 term."""
    prepared = _prepared(train, label)
    width = prepared.select(F.size("features")).first()[0]
    model = MultilayerPerceptronClassifier(
        featuresCol="__x", labelCol="__y", layers=[width, *hidden, 2], seed=seed, maxIter=max_iter
    )
    grid = None
    if cv_key:
        layers = [[width, *sizes, 2] for sizes in MLP_LAYERS]
        grid = ParamGridBuilder().addGrid(model.layers, layers)
    return _fit(model, prepared, grid and grid.build(), cv_key, seed)


TRAINERS = {
    "logistic_regression": train_logistic,
    "random_forest": train_forest,
    "mlp": train_mlp,
}


def predict(model, data: DataFrame, name: str, label: str = "label") -> DataFrame:
    """Probability of class 1 for every row -> all columns but the vector, model, probability."""
    kept = [c for c in data.columns if c != "features"]
    scored = model.transform(_prepared(data, label))
    return scored.select(
        *kept,
        F.lit(name).alias("model"),
        vector_to_array("probability")[1].alias("probability"),
    )


def fit_models(
    train: DataFrame,
    test: DataFrame,
    models: Sequence[str],
    label: str = "label",
    cv_key: str | None = None,
    seed: int = 0,
    params: dict | None = None,
) -> DataFrame:
    """Train every named model and score ``test`` with each -> test columns, model, probability."""
    unknown = [m for m in models if m not in TRAINERS]
    if unknown:
        raise ValueError(f"unknown models {unknown}")
    scored = []
    for name in models:
        options = (params or {}).get(name, {})
        model = TRAINERS[name](train, label, cv_key=cv_key, seed=seed, **options)
        scored.append(predict(model, test, name, label))
    out = scored[0]
    for part in scored[1:]:
        out = out.unionByName(part)
    return out


def population_fitness(
    members: DataFrame, answers: DataFrame, labels: DataFrame, model: str = "logreg", seed: int = 0
) -> DataFrame:
    """Score candidate query sets -> solution_id, fitness_train, fitness_eval, fitness_min.

    members: solution_id, pos, query_id, variant; answers: query_id, variant, answers (an array in the order of the
    dataset ids); labels: dataset_id, phase, label. Each solution's answers are standardised on the train datasets
    and the model fitted; one group is (datasets x queries of one solution), both set by the search parameters. What
    is shuffled is one row per query of a solution, and the labels once per solution.
    """
    listed = F.array_sort(F.collect_list(F.struct("dataset_id", (F.col("phase") == "train").alias("train"), "label")))
    packed = labels.agg(listed.alias("l")).select("l.train", "l.label")
    rows = members.join(answers.select("query_id", "variant", "answers"), ["query_id", "variant"])
    rows = rows.join(F.broadcast(packed), F.lit(True))  # exactly one row
    first = F.col("pos") == 0
    rows = rows.select(
        "solution_id", "pos", "answers", *[F.when(first, F.col(c)).alias(c) for c in ("train", "label")]
    )
    fit = FITS[model]

    def score(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        x = np.stack(group["answers"].to_numpy()).T.astype(float)
        train = np.asarray(group["train"].iloc[0], bool)
        y = np.asarray(group["label"].iloc[0], float)
        x = scaled(x, train)
        right = (fit(x[train], y[train], seed)(x) > 0.5) == (y == 1)
        fit_train, fit_eval = float(right[train].mean()), float(right[~train].mean())
        return pd.DataFrame(
            {
                "solution_id": [group["solution_id"].iloc[0]],
                "fitness_train": [fit_train],
                "fitness_eval": [fit_eval],
                "fitness_min": [min(fit_train, fit_eval)],
            }
        )

    schema = "solution_id bigint, fitness_train double, fitness_eval double, fitness_min double"
    return rows.groupBy("solution_id").applyInPandas(score, schema)


def grouped_fits(matrix: DataFrame, keys: Sequence[str], models: dict[str, str], seed: int = 0) -> DataFrame:
    """Fit every named model once per group and score all its rows -> matrix columns but features, model, probability.

    ``matrix``: keys, phase, features, label and other columns; models maps display names to ``small_models.FITS``. A
    group is one attacked target's datasets, as many as the audit draws; features are standardised on its train rows.
    """
    kept = [c for c in matrix.columns if c != "features"]
    types = dict(matrix.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["phase", "dataset_id"])
        x = np.stack(group["features"].to_numpy()).astype(float)
        train = (group["phase"] == "train").to_numpy()
        x, y = scaled(x, train), group["label"].to_numpy(float)
        parts = []
        for name, kind in models.items():
            probability = FITS[kind](x[train], y[train], seed)(x)
            parts.append(group[kept].assign(model=name, probability=probability))
        return pd.concat(parts)

    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", model string, probability double"
    return matrix.groupBy(*keys).applyInPandas(run, schema)
