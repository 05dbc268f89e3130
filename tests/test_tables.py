import gzip
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tablerisk.functions.ranks import bucketed_rank, grouped_quantile
from tablerisk.operators import prep as P
from tablerisk.operators import sampling as R
from tablerisk.operators import shadow as H
from tablerisk.sources.results import resume_targets, run_key, write_results
from tablerisk.functions import ranks
from tablerisk.sources.tables import ingest_discretized, load_table, read_metadata, read_raw
from tablerisk.spec import TableSpec


def test_metadata_and_csv(spark, tmp_path):
    meta = [
        {"name": "age", "type": "Integer", "min": 0, "max": 90},
        {"name": "job", "type": "finite", "representation": ["a", "b"]},
        {"name": "gain", "type": "Float"},
        {"name": "note", "type": "Text"},
    ]
    (tmp_path / "m.json").write_text(json.dumps(meta))
    spec = read_metadata(spark, str(tmp_path / "m.json"))
    assert spec.categorical == ("job",) and spec.continuous == ("age", "gain")
    assert spec.scaled == ("gain",) and spec.domain == {"job": ("a", "b")}
    (tmp_path / "d.csv").write_text("Person ID,age,job,gain\n7,30,a,1.5\n8,,,2\n9,40,b,3\n")
    rows = load_table(spark, str(tmp_path / "d.csv"), spec, fmt="csv").orderBy("record_id").collect()
    assert [r.record_id for r in rows] == [0, 1, 2]
    assert rows[1].job == "nan" and rows[1].age is None and "Person ID" not in rows[0]


def test_raw_files_are_appended_and_coded(spark, tmp_path):
    with gzip.open(tmp_path / "train.gz", "wt") as f:
        f.write("b\t10\tx\nc\t9\tx\n")
    (tmp_path / "test.tsv").write_text("a\t100\tx\n")
    raw = read_raw(
        spark, [str(tmp_path / "train.gz"), str(tmp_path / "test.tsv")], ["k", "n", "w"], ["w"], sep="\t"
    )
    out = ingest_discretized(raw, sink=str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    # text columns are coded in string order: "10" < "100" < "9"
    assert {(r.k, r.n) for r in out.collect()} == {(1, 0), (2, 2), (0, 1)}


@pytest.mark.parametrize("limit", [50_000, 3])
def test_value_codes_small_and_large_path(spark, monkeypatch, limit):
    monkeypatch.setattr(P, "LOCAL_VALUES", limit)
    df = spark.createDataFrame(
        [(0, "b", 10.0), (1, None, 9.0), (2, "é", None), (3, "B", 9.0), (4, "b", 100.0)],
        "record_id bigint, s string, x double",
    )
    coded, mapping = P.discretize(df, ["s", "x"])
    got = {r.record_id: (r.s, r.x) for r in coded.collect()}
    assert got == {0: (2, 2), 1: (0, 1), 2: (3, 0), 3: (1, 1), 4: (2, 3)}
    assert mapping.count() == 8


@pytest.mark.parametrize("limit", [50_000, 2])
def test_value_codes_keep_large_integers_apart(spark, monkeypatch, limit):
    monkeypatch.setattr(P, "LOCAL_VALUES", limit)
    rows = [(0, 2**60 + 1, float("nan")), (1, 2**60, 5.0), (2, 2**60 + 2, -1e300), (3, None, None)]
    df = spark.createDataFrame(rows, "record_id bigint, n bigint, x double")
    coded, _ = P.discretize(df, ["n", "x"])
    assert {r.record_id: (r.n, r.x) for r in coded.collect()} == {0: (2, 3), 1: (1, 2), 2: (3, 1), 3: (0, 0)}


def test_exclude_identical_to_several_targets(spark):
    df = spark.range(50).select(F.col("id").alias("record_id"), (F.col("id") % 7).alias("a"))
    left = P.exclude_identical(df, df.filter("record_id in (3, 4)"), ["a"])
    assert left.count() == sum(i % 7 not in (3, 4) for i in range(50))
    with pytest.raises(ValueError):
        P.single_record(df)


def test_constant_column_becomes_null(spark):
    df = spark.createDataFrame([(0, 2.0, 1.0), (1, 2.0, 3.0)], "record_id bigint, a double, b double")
    rows = P.minmax_normalize(df, ["a", "b"], df).orderBy("record_id").collect()
    assert rows[0].a is None and (rows[0].b, rows[1].b) == (0.0, 1.0)


def test_unseen_category_raises(spark):
    df = spark.createDataFrame([(0, "z")], "record_id bigint, a string")
    with pytest.raises(PySparkException):
        P.one_hot(df, TableSpec(("a",), (), domain={"a": ("x", "y")})).collect()


def test_select_and_attribute_sampling():
    spec = TableSpec(("a", "b"), ("c", "d"), ("d",), {"a": (1,), "b": (1,)}, ("a", "c", "b", "d"))
    assert spec.select(["all"]) is spec
    chosen = spec.select(["d", "b"])
    assert chosen.columns == ("d", "b") and chosen.categorical == ("b",) and chosen.scaled == ("d",)
    assert len(P.sample_attributes(spec, 2, 1).columns) == 2
    with pytest.raises(ValueError):
        P.sample_attributes(spec, 5, 1)


def test_random_split_sizes(spark):
    df = spark.range(500).withColumnRenamed("id", "record_id")
    got = {r.split: r["count"] for r in P.random_split(df, 100, None, 3).groupBy("split").count().collect()}
    assert got == {"test": 100, "aux": 400}
    with pytest.raises(ValueError):
        P.random_split(df, 400, 200, 3)


@pytest.mark.parametrize("n", [101, 100, 1])
def test_halve_pool(spark, n):
    df = spark.range(n).select((F.col("id") * 7 + 3).alias("record_id"))
    got = {r.pool: r["count"] for r in P.halve_pool(df).groupBy("pool").count().collect()}
    assert got.get("train", 0) == n // 2 and got["eval"] == n - n // 2


def test_halve_pool_of_large_ids(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SORTED_AT_ONCE", 10)
    df = spark.range(1001).select((F.col("id") * 3 + F.lit(2**60)).alias("record_id"))
    got = P.halve_pool(df).groupBy("pool").agg(F.count("*").alias("n"), F.max("record_id").alias("m")).collect()
    assert {r.pool: (r.n, r.m - 2**60) for r in got} == {"train": (500, 499 * 3), "eval": (501, 1000 * 3)}


def test_smaller_samples_are_part_of_larger_ones(spark):
    pool = spark.range(800).withColumnRenamed("id", "record_id")
    drawn = {n: {tuple(r) for r in R.sample_per_dataset(pool, R.dataset_ids(spark, 3), n, 5).collect()} for n in (100, 101, 799)}
    assert drawn[100] < drawn[101] < drawn[799]


@pytest.mark.parametrize("n", [1, 10, 60, 200])
def test_sampling_is_exact_and_distinct(spark, n):
    pool = spark.range(200).withColumnRenamed("id", "record_id")
    drawn = R.sample_per_dataset(pool, R.dataset_ids(spark, 7), n, 5).toPandas()
    assert len(drawn) == 7 * n and len(drawn.drop_duplicates()) == 7 * n
    again = R.sample_per_dataset(pool.repartition(3), R.dataset_ids(spark, 7), n, 5).toPandas()
    key = ["dataset_id", "record_id"]
    assert drawn.sort_values(key).values.tolist() == again.sort_values(key).values.tolist()
    with pytest.raises(ValueError):
        R.sample_per_dataset(pool, R.dataset_ids(spark, 1), 201, 5)


def test_sampling_is_even(spark):
    pool = spark.range(400).withColumnRenamed("id", "record_id")
    drawn = R.sample_per_dataset(pool, R.dataset_ids(spark, 400), 40, 5)
    hits = drawn.groupBy("record_id").count().toPandas()["count"]
    assert len(hits) == 400 and 15 < hits.min() and hits.max() < 70  # 40 expected, sd 6


def test_tables_nearly_as_large_as_the_pool(spark):
    df = spark.range(40).select(F.col("id").alias("record_id"), (F.col("id") % 7).alias("a"))
    tables = H.shadow_tables(df.filter("record_id >= 10"), df.filter("record_id < 2"), 25, 4, 1)
    got = tables.groupBy("target_id", "dataset_id").agg(F.countDistinct("record_id").alias("n"))
    assert [r.n for r in got.collect()] == [25] * 8


def test_target_is_absent_from_out_tables(spark):
    df = spark.range(300).select(F.col("id").alias("record_id"), (F.col("id") % 7).alias("a"))
    target = df.filter("record_id = 5")
    tables = H.shadow_tables(df.filter("record_id >= 100"), target, 20, 6, 1)
    seen = tables.groupBy("dataset_id", "in_dataset").agg(
        F.count("*").alias("n"), F.max((F.col("record_id") == 5).cast("int")).alias("has")
    )
    for r in seen.collect():
        assert r.n == 20 and r.has == int(r.in_dataset)
    special = H.shadow_tables_specific(df.filter("record_id < 50"), target, df, 6, 1)
    for r in special.groupBy("dataset_id", "in_dataset").agg(
        F.count("*").alias("n"), F.sum((F.col("record_id") == 5).cast("int")).alias("has")
    ).collect():
        assert r.n == 50 and r.has == int(r.in_dataset)


def test_ranks_with_a_hot_group(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") < 1500, 0).otherwise(F.col("id") % 9).alias("g"), (F.col("id") * 7919 % 2003).alias("x")
    )
    got = bucketed_rank(df, ["g"], F.shiftright("x", 6), [F.col("x")], "r").toPandas()
    for _, g in got.groupby("g"):
        assert list(g.sort_values("x")["r"]) == list(range(len(g)))


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.75, 1.0])
@pytest.mark.parametrize("margin", [0.001, 0.0])
def test_quantiles_are_exact(spark, q, margin):
    df = spark.range(3001).select(
        F.when(F.col("id") < 2500, 0).otherwise(F.col("id") % 5).alias("g"),
        F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.exp(F.sin("id") * 20)).alias("x"),
    )
    mine = {r.g: r.q for r in grouped_quantile(df, ["g"], "x", q, "q", margin).collect()}
    exact = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("x", q).alias("q")).collect()}
    assert mine == pytest.approx(exact)


def test_resume(spark, tmp_path):
    targets = spark.range(4).withColumnRenamed("id", "record_id")
    path = str(tmp_path / "results")
    assert resume_targets(targets, path, "record_id").count() == 4
    done = targets.filter("record_id < 2").withColumn("auc", F.lit(0.5)).withColumn("model", F.lit("m"))
    assert write_results(done, path, ["model"]).count() == 2
    assert {r[0] for r in resume_targets(targets, path, "record_id").collect()} == {2, 3}
    assert run_key({"a": 1, "b": 2}) == run_key({"b": 2, "a": 1}) != run_key({"a": 2, "b": 2})
