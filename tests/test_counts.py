import itertools

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tablerisk.operators import counts as C
from tablerisk.operators import querysets as S
from tablerisk.spec import Mechanism, TableSpec

OPS = {
    1: np.equal,
    -1: np.not_equal,
    2: np.greater,
    3: np.greater_equal,
    -2: np.less,
    -3: np.less_equal,
}


def queries_table(spark, vectors):
    rows = [(i, list(v)) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "query_id bigint, conditions array<int>")


def ask(spark, rows, vectors, values, int_domain=True):
    width = len(rows[0])
    columns = [f"c{i}" for i in range(width)]
    schema = "record_id bigint, " + ", ".join(f"{c} double" for c in columns)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], schema)
    literal = spark.createDataFrame(
        [(0, *map(float, values))], "value_id bigint, " + ", ".join(f"{c} double" for c in columns)
    )
    return C.count_queries(
        df, columns, queries_table(spark, vectors), literal, int_domain=int_domain
    )


def test_all_condition_vectors_match_naive(spark):
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 4, (200, 3))
    vectors = list(itertools.product([0, 1, -1, 2, 3, -2, -3], repeat=3))
    got = {r.query_id: r.cnt for r in ask(spark, rows.tolist(), vectors, (1, 2, 3)).collect()}
    for i, vector in enumerate(vectors):
        hit = np.ones(200, bool)
        for c, (condition, value) in enumerate(zip(vector, (1, 2, 3))):
            if condition:
                hit &= OPS[condition](rows[:, c], value)
        assert got[i] == hit.sum()


def test_more_than_21_columns(spark):
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 2, (50, 25))
    vectors = [[0] * 25, [1] + [0] * 23 + [1], [0] * 24 + [-1]]
    got = {r.query_id: r.cnt for r in ask(spark, rows.tolist(), vectors, [1] * 25).collect()}
    assert got == {0: 50, 1: int((rows[:, 0] & rows[:, 24]).sum()), 2: int((rows[:, 24] != 1).sum())}


def test_truncation_to_integers(spark):
    rows = [(0.99,), (1.0,)]
    assert ask(spark, rows, [[3]], (1.0,)).first().cnt == 1
    assert ask(spark, rows, [[3]], (0.99,), int_domain=False).first().cnt == 2
    assert ask(spark, rows, [[3]], (0.99,)).first().cnt == 2  # everything becomes 0 or 1


def test_missing_value_fails_every_condition(spark):
    df = spark.createDataFrame([(0, None), (1, 1)], "record_id bigint, a int")
    values = spark.createDataFrame([(0, 1)], "value_id bigint, a int")
    got = C.count_queries(df, ["a"], queries_table(spark, [[0], [1], [-1]]), values)
    assert {r.query_id: r.cnt for r in got.collect()} == {0: 2, 1: 1, 2: 0}


def test_empty_table_answers_zero(spark):
    df = spark.createDataFrame([], "record_id bigint, a int")
    values = spark.createDataFrame([(0, 1)], "value_id bigint, a int")
    got = C.count_queries(df, ["a"], queries_table(spark, [[0], [1]]), values)
    assert [r.cnt for r in got.collect()] == [0, 0]


def test_unknown_condition_raises(spark):
    with pytest.raises(PySparkException):
        ask(spark, [(1,)], [[5]], (1,)).collect()


def test_structured_sensitive_literal_is_one(spark):
    rows = [(0, 3, 0), (1, 3, 1), (2, 3, 1), (3, 4, 1)]
    df = spark.createDataFrame(rows, "record_id bigint, a int, sensitive int")
    users = spark.createDataFrame([(0,)], "user_id bigint")
    got = C.structured_counts(
        df, ["a", "sensitive"], users, queries_table(spark, [[1, 1], [1, -1]])
    )
    assert {r.query_id: r.cnt for r in got.collect()} == {0: 2, 1: 1}


def test_sticky_noise_smoke(spark):
    got = ask(spark, [(0, 0, 0)] * 10, [(-1, 0, -2), (-1, 0, -2)], (1, 2, 3))
    assert [r.cnt for r in got.collect()] == [10, 10]
    answers = [r.answer for r in C.counts_sticky_uniform(got, 4, 2, 9).collect()]
    assert answers[0] == answers[1] and 8 <= answers[0] <= 12


def test_suppression_edge_and_clamp(spark):
    counts = spark.createDataFrame(
        [(i, c, 7 * i) for i, c in enumerate((3, 4, 5))], "query_id bigint, cnt bigint, set_hash bigint"
    )
    for noisy in (C.counts_sticky_uniform(counts, 4, 2, 1), C.counts_threshold_gaussian(counts, 4, 0.0, 1)):
        got = {r.query_id: r.answer for r in noisy.collect()}
        assert got[0] == got[1] == 0 and 3 <= got[2] <= 7
    many = spark.range(2000).select(
        F.col("id").alias("query_id"), F.lit(1).cast("bigint").alias("cnt"), F.col("id").alias("set_hash")
    )
    noisy = C.counts_threshold_gaussian(many, 0, 5.0, 3).toPandas()["answer"]
    assert noisy.min() == 0 and noisy.max() > 5


def test_noise_distributions(spark):
    many = spark.range(20000).select(
        F.col("id").alias("query_id"),
        F.lit(10000).cast("bigint").alias("cnt"),
        F.col("id").alias("set_hash"),
        F.lit(1.0).alias("budget"),
    )
    normal = C.counts_threshold_gaussian(many, 0, 100.0, 3).toPandas()["answer"] - 10000
    assert abs(normal.mean()) < 3 and 97 < normal.std() < 103
    laplace = C.counts_dp_laplace(many, 0.01, 3).toPandas()["answer"] - 10000
    assert abs(laplace.mean()) < 4 and 137 < laplace.std() < 146
    uniform = C.counts_sticky_uniform(many, 4, 2, 3).toPandas()["answer"] - 10000
    assert set(uniform) == {-2, -1, 0, 1, 2} and uniform.value_counts().min() > 3700


@pytest.mark.parametrize("budget", [0.0, 1.2, None])
def test_budget_must_be_a_fraction(spark, budget):
    counts = spark.createDataFrame([(0, 5, budget)], "query_id bigint, cnt bigint, budget double")
    with pytest.raises(PySparkException):
        C.counts_dp_laplace(counts, 1.0, 0).collect()


def test_mechanism_determinism():
    assert Mechanism("table-builder").deterministic and Mechanism("simple").deterministic
    assert not Mechanism("simple", scale=1.0).deterministic
    assert not Mechanism("dp-laplace").deterministic
    with pytest.raises(ValueError):
        Mechanism("other")


def test_lattice_sizes_and_limit(spark):
    spec = TableSpec(("a", "b"), ("c",))
    assert S.query_lattice(spark, spec, [1, 2, 3]).count() == 7
    both = S.query_lattice(spark, spec, [1, 2, 3], (1, -1), (2, 3))
    assert both.count() == 26 == both.select("conditions").distinct().count()
    assert S.lattice_size(spec, [1, 2, 3], 2, 2) == 26
    few = S.query_lattice(spark, spec, [1, 2, 3], (1, -1), (2, 3), limit=9)
    assert few.count() == 9 and few.join(both, "query_id", "left_anti").count() == 0


def test_wide_lattices_of_low_order(spark):
    columns = tuple(f"c{i}" for i in range(60))
    wide = S.query_lattice(spark, TableSpec(columns, ()), [2])
    rows = wide.select("query_id", "conditions").collect()
    assert len(rows) == 60 * 59 // 2
    for r in rows:
        held = [i for i, c in enumerate(r.conditions) if c]
        assert r.query_id == sum(1 << i for i in held) and len(held) == 2
    mixed = S.query_lattice(spark, TableSpec(columns[:20], columns[20:35]), [1, 3], (1, -1), (2,))
    assert mixed.count() == S.lattice_size(TableSpec(columns[:20], columns[20:35]), [1, 3], 2, 1)
    with pytest.raises(ValueError):
        S.query_lattice(spark, TableSpec(columns, ()), [2], (1, -1))


def drawn_queries(seed, n=70, width=4):
    """Random condition vectors over {-1, 0, 1} with repeats."""
    rng = np.random.default_rng(seed)
    vectors = [tuple(int(v) for v in row) for row in rng.integers(-1, 2, (n, width))]
    return vectors + vectors[:3]


@pytest.mark.parametrize("seed", [1, 2])
def test_difference_pairs_equal_brute_force(spark, seed):
    vectors = drawn_queries(seed)
    distinct, text = set(vectors), lambda v: ",".join(map(str, v))
    expected, paired = set(), set()
    # a leading query has a condition on the last, sensitive column and no -1 before it
    for v in (v for v in distinct if v[-1] and -1 not in v[:-1]):
        for i in range(len(v) - 1):
            partner = (*v[:i], -1, *v[i + 1 :])
            if v[i] == 0 and partner in distinct:
                expected.add((text(v), text(partner), i))
                paired |= {v, partner}
    pairs, rest = S.difference_query_pairs(queries_table(spark, vectors))
    got = {(r.leading, r.partner, r.position) for r in pairs.collect()}
    assert got == expected and len(expected) > 3
    assert rest.count() == len(distinct - paired)


def test_multiplicity_occurrences_shares(spark):
    vectors = [(1, 0, -1), (0, 0, 1), (1, 0, -1), (1, 1, 1)]
    df = queries_table(spark, vectors)
    top = S.query_multiplicity(df).orderBy(F.desc("multiplicity")).first()
    assert top.multiplicity == 2 and tuple(top.conditions) == (1, 0, -1)
    assert top.n_conditions == 2
    numbered = S.query_occurrences(queries_table(spark, [(1,), (2,), (1,), (3,)]), "query_id")
    assert [(r.conditions[0], r.occurrence) for r in numbered.orderBy("query_id").collect()] == [
        (1, 0), (2, 0), (1, 1), (3, 0),
    ]
    assert S.budget_shares(df).agg(F.sum("budget")).first()[0] == pytest.approx(1.0)


def many_ways(spark, rows, vectors, values, keys, int_domain, monkeypatch):
    """The same counts by states and by projections -> (keys, value_id, query_id, cnt, set_hash) sets."""
    width = len(vectors[0])
    columns = [f"c{i}" for i in range(width)]
    fields = ", ".join(f"{c} double" for c in columns)
    df = spark.createDataFrame(rows, f"record_id bigint, dataset_id bigint, {fields}")
    literals = spark.createDataFrame(values, f"value_id bigint, {fields}")
    out = []
    for limit in (1000, 0):
        monkeypatch.setattr(C, "VALUE_ROWS", limit)
        got = C.count_queries(df, columns, queries_table(spark, vectors), literals, keys, int_domain)
        out.append(sorted(map(tuple, got.select(*keys, "value_id", "query_id", "cnt", "set_hash").collect())))
    return out


@pytest.mark.parametrize("keys", [(), ("dataset_id",)])
@pytest.mark.parametrize("int_domain", [True, False])
def test_projections_equal_states(spark, monkeypatch, keys, int_domain):
    rng = np.random.default_rng(4)
    pick = lambda: None if rng.random() < 0.1 else float(rng.choice([-3, -0.0, 0.0, 0.5, 1, 2, 7, 1e6]))
    rows = [(i, i % 3, pick(), pick()) for i in range(120)]
    values = [(100 + i, pick(), pick()) for i in range(25)] + [(1, None, None), (2, 2.5, -1e9), (3, 2.5, -1e9)]
    vectors = list(itertools.product([0, 1, -1, 2, 3, -2, -3], repeat=2))
    states, projections = many_ways(spark, rows, vectors, values, keys, int_domain, monkeypatch)
    assert states == projections and len(states) == 49 * 28 * (3 if keys else 1)


def test_projections_of_an_empty_table_and_of_bad_queries(spark, monkeypatch):
    monkeypatch.setattr(C, "VALUE_ROWS", 0)
    df = spark.createDataFrame([], "record_id bigint, a int")
    values = spark.createDataFrame([(0, 1)], "value_id bigint, a int")
    got = C.count_queries(df, ["a"], queries_table(spark, [[0], [1], [-2]]), values)
    assert [r.cnt for r in got.collect()] == [0, 0, 0]
    with pytest.raises(PySparkException):
        C.count_queries(df, ["a"], queries_table(spark, [[5]]), values).collect()
    with pytest.raises(ValueError):
        C.count_queries(df, ["a"], queries_table(spark, [[0]]), values.union(values))


def test_structured_counts_of_all_users_join_by_keys_alone(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 4)), int(rng.integers(0, 3)), int(rng.integers(0, 2))) for i in range(300)]
    df = spark.createDataFrame(rows, "record_id bigint, a int, b int, sensitive int")
    vectors = [v for v in itertools.product([0, 1, -1], [0, 1, -1, 2, -3], [0, 1, -1])]
    users = df.select(F.col("record_id").alias("user_id"))
    got = C.structured_counts(df, ["a", "b", "sensitive"], users, queries_table(spark, vectors))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    table = np.array(rows)
    answers = {(r.user_id, r.query_id): r.cnt for r in got.collect()}
    assert len(answers) == 300 * len(vectors)
    for user in range(0, 300, 7):
        for q, vector in enumerate(vectors):
            hit = np.ones(300, bool)
            for c, condition in enumerate(vector):
                value = 1 if c == 2 else table[user, c + 1]
                if condition:
                    hit &= OPS[condition](table[:, c + 1], value)
            assert answers[user, q] == hit.sum()
