import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablerisk.operators import nearest as N
from tablerisk.spec import TableSpec


def brute(pdf, cats, conts, k):
    n = len(cats) + len(conts)
    codes = pdf[cats].to_numpy() if cats else np.zeros((len(pdf), 0))
    x = pdf[conts].to_numpy(float) if conts else np.zeros((len(pdf), 0))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    out = []
    for i in range(len(pdf)):
        d = (len(cats) - (codes == codes[i]).sum(1)) / n
        if conts:
            d = d + len(conts) / n * (1 - unit @ unit[i])
        out.append(np.sort(d)[:k].mean())
    return np.array(out)


def table(n=400, seed=0):
    rng = np.random.default_rng(seed)
    return pd.DataFrame(
        {
            "record_id": np.arange(n),
            "a": rng.choice(["x", "y", "z"], n, p=[0.7, 0.2, 0.1]),
            "b": rng.choice(list("pqrstuvw"), n),
            "u": rng.integers(0, 12, n).astype(float),
            "v": rng.random(n).round(2),
            "w": rng.normal(size=n).round(1),
        }
    )


@pytest.mark.parametrize(
    "cats, conts",
    [(["a", "b"], ["u", "v"]), (["a"], ["u", "v", "w"]), (["a", "b"], []), ([], ["u", "w"])],
)
@pytest.mark.parametrize("sizes", [{}, {"cell_rows": 60, "block_rows": 70, "max_cells": 12}])
def test_scores_equal_brute_force(spark, cats, conts, sizes):
    pdf = table()
    pdf.loc[:130, ["a", "b", "u", "v", "w"]] = ["x", "p", 3.0, 0.5, 0.5]  # a third are equal
    pdf.loc[131:140, ["u", "v", "w"]] = 0.0  # zero vectors
    spec = TableSpec(tuple(cats), tuple(conts))
    scores = N.achilles_scores(spark.createDataFrame(pdf), spec, 5, **sizes).toPandas()
    assert len(scores) == len(pdf)
    got = pdf.merge(scores, on="record_id")["achilles_score"].to_numpy()
    np.testing.assert_allclose(got, brute(pdf, cats, conts, 5), atol=1e-12)


@pytest.mark.parametrize("sizes", [{}, {"cell_rows": 40, "block_rows": 50, "max_cells": 12}])
def test_missing_values_count_as_zero(spark, sizes):
    pdf = table(200, 3)
    holes = np.random.default_rng(1).random((200, 3)) < 0.2
    filled = pdf.copy()
    filled[["u", "v", "w"]] = np.where(holes, 0.0, pdf[["u", "v", "w"]])
    kind = np.where(np.arange(200)[:, None] % 2, None, np.nan)
    rows = [
        (int(r.record_id), r.a, *(kind[i, 0] if h else float(x) for h, x in zip(holes[i], (r.u, r.v, r.w))))
        for i, r in enumerate(pdf.itertuples())
    ]
    df = spark.createDataFrame(rows, "record_id bigint, a string, u double, v double, w double")
    got = N.achilles_scores(df, TableSpec(("a",), ("u", "v", "w")), 5, **sizes).toPandas().sort_values("record_id")
    np.testing.assert_allclose(got["achilles_score"], brute(filled, ["a"], ["u", "v", "w"], 5), atol=1e-12)


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.99, 1.0])
def test_quantiles_of_uneven_groups_are_exact(spark, q):
    from tablerisk.functions.ranks import grouped_quantile

    rng = np.random.default_rng(2)
    sets = {
        "long": rng.lognormal(0, 3, 3000), "ties": rng.integers(0, 3, 3000).astype(float), "one": np.array([4.5]),
        "ends": np.array([-np.inf, 1.0, 2.0, 3.0, np.inf, np.inf]), None: np.array([1.0, 2.0]),
    }
    rows = [(g, float(v)) for g, values in sets.items() for v in values] + [("ties", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r.g: r.q for r in grouped_quantile(df, ["g"], "v", q, "q").collect()}
    for g, values in sets.items():
        if g == "ends" and q in (0.99, 0.0, 1.0):
            continue  # between or at infinities
        assert got[g] == pytest.approx(np.quantile(values, q), rel=1e-12)


def test_twin_records_and_zero_vector(spark):
    rows = [(0, "x", 1.0, 2.0), (1, "x", 1.0, 2.0), (2, "y", -5.0, 1.0), (3, "z", 0.0, 0.0)]
    df = spark.createDataFrame(rows, "record_id bigint, a string, u double, v double")
    spec = TableSpec(("a",), ("u", "v"))
    got = {r[0]: r[1] for r in N.achilles_scores(df, spec, 2).collect()}
    assert abs(got[0]) < 1e-12 and abs(got[1]) < 1e-12
    # the zero record is at n_cont/n from itself, then at n_cont/n + 1/n from anyone else
    assert got[3] == pytest.approx((2 / 3 + 1.0) / 2)


def test_fewer_records_than_k(spark):
    df = spark.createDataFrame([(0, "x", 1.0), (1, "y", 1.0)], "record_id bigint, a string, u double")
    got = {r[0]: r[1] for r in N.achilles_scores(df, TableSpec(("a",), ("u",)), 5).collect()}
    assert got == pytest.approx({0: 0.25, 1: 0.25})


def test_similarity_ranks_cover_every_row(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") < 2500, 0).otherwise(F.col("id") % 5).cast("bigint").alias("dataset_id"),
        F.col("id").alias("record_id"),
        F.round(F.sin("id"), 2).alias("similarity"),
    )
    got = N.distance_features(df, ["dataset_id"]).toPandas()
    assert len(got) == 3000
    for _, g in got.groupby("dataset_id"):
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(len(g)))
        assert g["similarity"].is_monotonic_decreasing
