import numpy as np
import pytest
from pyspark.sql import functions as F

from tablerisk.operators import features as X
from tablerisk.operators import metrics as M
from tablerisk.operators import models as L
from tablerisk.operators import small_models as S
from tablerisk.operators import synthesis as Y
from tablerisk.operators.shadow import auxiliary_shadow
from tablerisk.plans import answer_store as A
from tablerisk.plans import query_search as Q
from tablerisk.plans import attribute as T
from tablerisk.plans.attribute import attribute_audit
from tablerisk.plans import membership as B
from tablerisk.plans.membership import membership_audit
from tablerisk.spec import Mechanism, TableSpec

SPEC = TableSpec(("a", "b"), ("x",), (), {"a": (0, 1, 2), "b": (0, 1, 2, 3)}, ("a", "b", "x"))


def people(spark, n=400):
    return spark.range(n).select(
        F.col("id").alias("record_id"),
        (F.col("id") % 3).alias("a"),
        (F.floor(F.col("id") / 3) % 4).alias("b"),
        ((F.col("id") * 37) % 50).cast("double").alias("x"),
    )


def test_whole_lattice_equals_sparse_path(spark):
    df = people(spark).withColumn("dataset_id", F.when(F.col("record_id") < 250, 0).otherwise(F.col("record_id") % 4))
    df = df.withColumn("dataset_id", F.col("dataset_id").cast("bigint")).withColumn("target_id", F.lit(7).cast("bigint"))
    target = people(spark).filter("record_id = 7")
    fast = X.query_features(df, SPEC, target, [1, 2, 3]).toPandas()
    slow = X.query_features(df, SPEC, target, [1, 2, 3], limit=7).toPandas()
    assert len(fast) == 4 * 7
    renamed = target.withColumnRenamed("record_id", "target_id")
    lattice = X.query_lattice(spark, SPEC, [1, 2, 3])
    counts = X.target_counts(df, ["a", "b", "x"], lattice, renamed, ["target_id", "dataset_id"]).toPandas()
    both = fast.merge(counts, left_on=["dataset_id", "feature_pos"], right_on=["dataset_id", "query_id"])
    assert len(both) == 28 and (both["value"] == both["cnt"]).all() and len(slow) == 28


def test_cancelling_features_are_dropped(spark):
    rows = [(0, 0, "z", 1.0), (0, 1, "z", -1.0), (0, 0, "k", 2.0), (0, 1, "k", 2.0)]
    train = spark.createDataFrame(rows, "target_id bigint, dataset_id bigint, feature string, value double")
    kept, _ = X.drop_zero_features(train, train)
    assert {r.feature for r in kept.collect()} == {"k"}
    scaled, _ = X.standardize_features(train, train)
    assert {r.value for r in scaled.filter("feature = 'k'").collect()} == {0.0}  # constant: divided by 1


def test_unknown_names_raise(spark):
    df = people(spark)
    with pytest.raises(ValueError):
        X.extract_features(df, SPEC, df, ["nope"])
    with pytest.raises(ValueError):
        Y.synthesize(df, SPEC, "nope", 1, 0)
    with pytest.raises(ValueError):
        L.fit_models(df, df, ["nope"])


def test_auc_of_one_class_is_null_and_ties_count_half(spark):
    rows = [("one", 0.1, 1), ("one", 0.9, 1), ("two", 0.5, 1), ("two", 0.5, 0), ("two", 0.7, 1), ("two", 0.2, 0)]
    df = spark.createDataFrame(rows, "g string, probability double, label int")
    got = {r.g: (r.accuracy, r.auc) for r in M.binary_metrics(df, ["g"]).collect()}
    assert got["one"] == (0.5, None)
    assert got["two"] == (0.75, pytest.approx(3.5 / 4))
    loose = {r.g: r.accuracy for r in M.binary_metrics(df, ["g"], strict=False).collect()}
    assert loose["two"] == 0.75


@pytest.mark.parametrize("name", ["indhist", "baynet", "privbayes", "synthpop", "identity"])
def test_synthesis_keeps_size_domain_and_marginals(spark, name):
    df = people(spark, 1200).withColumn("dataset_id", (F.col("record_id") % 2).cast("bigint"))
    made = Y.synthesize(df, SPEC, name, 600, 3, epsilon=20.0).toPandas()
    assert made.groupby("dataset_id").size().to_dict() == {0: 600, 1: 600}
    assert set(made["a"]) <= {0, 1, 2} and set(made["b"]) <= {0, 1, 2, 3}
    assert made["x"].between(0, 49).all() and not made.isna().any().any()
    share = made.groupby("a").size() / len(made)
    assert np.allclose(share, 1 / 3, atol=0.08)


@pytest.mark.parametrize("name", ["baynet", "synthpop"])
def test_synthesis_keeps_dependence(spark, name):
    df = spark.range(1000).select(
        F.lit(0).cast("bigint").alias("dataset_id"),
        F.col("id").alias("record_id"),
        (F.col("id") % 3).alias("a"),
        (F.col("id") % 3).alias("b"),
        ((F.col("id") % 3) * 10 + F.col("id") % 2).cast("double").alias("x"),
    )
    made = Y.synthesize(df, SPEC, name, 300, 1).toPandas()
    assert (made["a"] == made["b"]).mean() > 0.95
    assert np.corrcoef(made["a"], made["x"])[0, 1] > 0.95


def test_models_learn_and_cross_validate(spark):
    df = spark.range(300).select(
        F.col("id").alias("dataset_id"),
        (F.col("id") % 2).cast("int").alias("label"),
        F.array((F.col("id") % 2 + F.sin("id") / 4), F.cos("id")).alias("features"),
    )
    scored = L.fit_models(
        df, df, ["logistic_regression", "random_forest", "mlp"],
        params={"logistic_regression": {"c": 1.0}, "random_forest": {"trees": 10}, "mlp": {"hidden": (5,)}},
    )
    got = {r.model: r.auc for r in M.binary_metrics(scored, ["model"]).collect()}
    assert min(got.values()) > 0.95
    chosen = L.fit_models(df, df, ["logistic_regression"], cv_key="dataset_id")
    assert M.binary_metrics(chosen, ["model"]).first().auc > 0.95


def test_small_logistic_fit_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] - x[:, 1] > 0).astype(float)
    w = S.logistic_weights(x, y)
    assert (((x @ w[:-1] + w[-1]) > 0) == (y == 1)).mean() > 0.95


def test_solution_formats():
    a, b = (1, 0), (0, 1)
    assert A.formatted([a, b, a], Mechanism("simple", scale=1.0)) == [(a, 0), (b, 0), (a, 1)]
    assert A.formatted([a, b, a], Mechanism("table-builder")) == [(a, 0), (b, 0), (a, 0)]
    shares = dict(A.formatted([a, b, a, a], Mechanism("dp-laplace")))
    assert shares == {a: 750000, b: 250000}
    assert A.query_number((-1, -1)) == 0 and A.query_number((1, 1)) == 8


@pytest.mark.parametrize("mode", ["evolutionary", "random"])
def test_search_keeps_its_best_solution(spark, mode):
    df = people(spark).withColumn("x", F.floor(F.col("x") / 10))
    target = df.filter("record_id = 7")
    tables = auxiliary_shadow(df, target, ["a", "b", "x"], 20, 20, 1)
    config = Q.SearchConfig(6, 4, 2, mode=mode, p_copy=0.2, p_modify=0.4, p_switch=0.3, p_swap=0.3)
    found = Q.query_search(
        tables, ["a", "b", "x", "sensitive"], target, 7, Mechanism("simple", scale=0.5), config
    )
    log = found.log().orderBy("generation").toPandas()
    best = found.fitness_table().groupBy("generation").agg(F.max("fitness_min").alias("m")).orderBy("generation")
    best = [r.m for r in best.collect()]
    assert len(log) == 3 and best == sorted(best)
    assert len(found.population) == 6 and all(len(s) <= 4 for s in found.population)
    assert all(c in (-1, 0, 1) for s in found.population for q in s for c in q)
    assert found.best_solution().count() == len(found.population[0])


def test_answers_are_cached(spark):
    df = people(spark).withColumn("x", F.floor(F.col("x") / 10))
    target = df.filter("record_id = 7")
    tables = auxiliary_shadow(df, target, ["a", "b", "x"], 20, 4, 1)
    cache = A.AnswerStore(tables, ["a", "b", "x", "sensitive"], target, Mechanism("table-builder", 4), 1)
    first = {((1, 0, 0, 1), 0), ((0, 0, 0, -1), 0)}
    assert cache.update(first) == 2 and cache.update(first) == 0
    assert cache.update({((0, 0, 0, 0), 0)} | first) == 1
    assert cache.answers().count() == 4 * 3 and cache.asked == 3


def small_search(spark, tmp_path, name, generations, seed=2, scale=0.5):
    df = people(spark).withColumn("x", F.floor(F.col("x") / 10))
    target = df.filter("record_id = 7")
    tables = auxiliary_shadow(df, target, ["a", "b", "x"], 20, 12, 1)
    config = Q.SearchConfig(5, 4, generations, p_copy=0.2, p_modify=0.4, p_switch=0.3, p_swap=0.3, seed=seed)
    mechanism = Mechanism("simple", scale=scale)
    return Q.query_search(tables, ["a", "b", "x", "sensitive"], target, 7, mechanism, config, str(tmp_path / name))


def test_search_goes_on_after_its_driver_is_lost(spark, tmp_path, monkeypatch):
    whole = small_search(spark, tmp_path, "whole", 4)
    asked, answered = [], A.AnswerStore.update

    def counting(self, wanted):
        count = answered(self, wanted)
        asked.append(count)
        if len(asked) == 3:  # the third generation's answers are stored, its scores are not
            raise RuntimeError("driver lost")
        return count

    monkeypatch.setattr(A.AnswerStore, "update", counting)
    with pytest.raises(RuntimeError):
        small_search(spark, tmp_path, "cut", 4)
    resumed = small_search(spark, tmp_path, "cut", 4)
    order = ["generation", "rank"]
    logs = [f.fitness_table().orderBy(*order).collect() for f in (whole, resumed)]
    assert logs[0] == logs[1] and len(logs[0]) == 25
    assert whole.population == resumed.population
    assert resumed.store.asked == whole.store.asked == sum(asked) and asked[3] == 0
    again = small_search(spark, tmp_path, "cut", 4)
    assert "states" not in again.store.__dict__ and again.population == whole.population  # nothing was computed


def test_rows_without_a_marker_are_not_read(spark, tmp_path):
    from tablerisk.sources.batches import BatchTable

    table = BatchTable(spark, str(tmp_path / "t"), "a int")
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "a int")
    assert table.read().count() == 0
    table.append(rows(1, 2), {"n": 2})
    rows(9).write.parquet(str(tmp_path / "t/rows/batch=1"))  # a job that was killed before its marker
    again = BatchTable(spark, str(tmp_path / "t"), "a int")
    assert again.notes == {0: {"n": 2}} and [r.a for r in again.read().orderBy("a").collect()] == [1, 2]
    again.append(rows(3))
    assert sorted(r.a for r in again.read().collect()) == [1, 2, 3]
    assert [r.a for r in again.read([1]).collect()] == [3] and again.read([]).count() == 0


def test_readers_open_the_batches_of_their_queries(spark, tmp_path):
    df = people(spark).withColumn("x", F.floor(F.col("x") / 10))
    target = df.filter("record_id = 7")
    tables = auxiliary_shadow(df, target, ["a", "b", "x"], 20, 4, 1)
    store = A.AnswerStore(tables, ["a", "b", "x", "sensitive"], target, Mechanism("simple"), 1, str(tmp_path))
    queries = [((1, 0, 0, 1), 0), ((0, 0, 0, -1), 0), ((0, 1, 0, 0), 0)]
    for query in queries:
        store.update([query])
    rows = store.rows(A.members_table(spark, [queries[1:2]]))
    assert rows.count() == 1 and all("batch=1/" in f for f in rows.inputFiles())


def test_perceptron_learns_what_no_line_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    fit = S.perceptron(x[:500], y[:500], seed=3, rate=1e-2)
    assert ((fit(x[500:]) > 0.5) == (y[500:] == 1)).mean() > 0.9
    strong = S.perceptron(x[:500], y[:500], seed=3, rate=1e-2, alpha=1e4)
    assert np.ptp(strong(x)) < 0.2  # a strong penalty leaves nothing to tell rows apart


def test_population_is_scored_by_either_model(spark):
    labels = spark.createDataFrame([(d, "train" if d < 900 else "eval", d % 2) for d in range(1200)], "dataset_id long, phase string, label int")
    told = [[d % 2 * 5 for d in range(1200)], [d * 7 % 11 for d in range(1200)]]
    answers = spark.createDataFrame([(q, 0, told[q]) for q in (0, 1)], "query_id long, variant long, answers array<long>")
    members = spark.createDataFrame([(0, 0, 1, 0), (0, 1, 0, 0), (1, 0, 1, 0)], "solution_id long, pos long, query_id long, variant long")
    for model in ("logreg", "mlp"):
        got = {r.solution_id: r for r in L.population_fitness(members, answers, labels, model).collect()}
        assert got[0].fitness_min > 0.95 > 0.8 > got[1].fitness_min


def test_attribute_audit_finds_an_open_secret(spark, tmp_path, monkeypatch):
    df = people(spark, 300).withColumn("x", F.floor(F.col("x") / 10))
    split = df.withColumn("split", F.when(F.col("record_id") % 2 == 0, "aux").otherwise("test"))
    # exact counts and a fixed dataset: the sensitive count itself gives the bit away
    got = attribute_audit(
        split, ["a", "b", "x"], [7], Mechanism("simple"), "exact",
        Q.SearchConfig(6, 6, 1), n_rows=40, n_datasets=30, n_tests=10, folder=str(tmp_path),
    ).toPandas()
    assert set(got["model"]) == {"logreg", "mlp"}
    assert got["acc_test"].between(0, 1).all() and got["auc_test"].max() > 0.9
    assert (got["asked"] > 6).all()
    # predictions are stored: the rerun audits nobody
    monkeypatch.setattr(T, "audit_one_target", None)
    again = attribute_audit(
        split, ["a", "b", "x"], [7], Mechanism("simple"), "exact",
        Q.SearchConfig(6, 6, 1), n_rows=40, n_datasets=30, n_tests=10, folder=str(tmp_path),
    ).toPandas()
    assert again.sort_values("model").reset_index(drop=True).equals(got.sort_values("model").reset_index(drop=True))


def test_membership_audit_identity_is_detected(spark, tmp_path, monkeypatch):
    df = people(spark, 300).withColumn(
        "split",
        F.when(F.col("record_id") < 150, "aux").when(F.col("record_id") % 3 == 0, "target").otherwise("eval"),
    )
    both = df.filter("split <> 'target'").unionByName(df.filter("split = 'target'")).unionByName(
        df.filter("split = 'target'").withColumn("split", F.lit("eval"))
    )
    # an outlying target released as is: its own query count tells membership apart
    odd = both.withColumn("x", F.when(F.col("record_id") == 201, 900.0).otherwise(F.col("x")))
    chosen = odd.filter("record_id in (201, 204, 207) and split = 'target'")
    options = dict(
        synthesizer="identity", n_original=30, n_datasets=20, models=("logistic_regression",),
        evaluations=("specific", "average"), folder=str(tmp_path),
    )
    first = membership_audit(odd, SPEC, chosen.filter("record_id = 201"), **options).toPandas()
    assert set(first["evaluation"]) == {"train", "specific", "average"}
    assert (first["auc"] > 0.95).all()
    # more targets in rounds of one: the stored one is kept, and a complete rerun computes nothing
    monkeypatch.setattr(B, "TARGETS_AT_ONCE", 1)
    rounds, vectors = [], B.attack_vectors
    monkeypatch.setattr(B, "attack_vectors", lambda *a, **k: rounds.append(1) or vectors(*a, **k))
    for _ in range(2):
        got = membership_audit(odd, SPEC, chosen, **options).toPandas()
        assert len(rounds) == 3 - 1 and len(got) == 3 * 3
    # alone or among others, alike but for the numbers that name its tables
    assert (got[got["record_id"] == 201]["auc"] > 0.95).all()


def test_specific_tables_of_several_targets(spark):
    from tablerisk.operators.shadow import shadow_tables_specific

    df = people(spark, 60)
    base, pool = df.filter("record_id < 30"), df.filter("record_id >= 25")
    targets = df.filter("record_id in (3, 27, 29)")
    rows = shadow_tables_specific(base, targets, pool, 8, 5).toPandas()
    for k, target in enumerate((3, 27, 29)):
        mine = rows[rows["target_id"] == target]
        assert set(mine["dataset_id"]) == set(range(8 * k, 8 * k + 8))
        for dataset, own in mine.groupby("dataset_id"):
            ids = set(own["record_id"])
            assert (target in ids) == (dataset % 2 == 0) == own["in_dataset"].all()
            assert len(own) == 30 and set(range(30)) - {target} <= ids
            extra = list(own["record_id"])
            for x in set(range(30)) - {target}:
                extra.remove(x)
            assert len(extra) == 1 and (extra[0] == target if dataset % 2 == 0 else 25 <= extra[0] != target)


def test_overlay_is_the_copies(spark):
    from tablerisk.operators.overlay import exact_overlay
    from tablerisk.operators.sampling import exact_shadow

    df = people(spark, 90).withColumn("x", F.floor(F.col("x") / 10)).withColumn("sensitive", (F.col("record_id") % 5 > 2).cast("int"))
    overlay, copies = exact_overlay(df, 12, 4, 7), exact_shadow(df, 12, 4, 7)
    order = ["dataset_id", *df.columns]
    assert sorted(overlay.tables().select(*order).collect()) == sorted(copies.select(*order).collect())
    target, columns = df.filter("record_id = 7"), ["a", "b", "x", "sensitive"]
    queries = [((x, y, z, s), 0) for x in (0, 1) for y in (0, -1) for z in (0, 1) for s in (0, 1, -1)]
    answers = []
    for tables in (overlay, copies):
        store = A.AnswerStore(tables, columns, target, Mechanism("table-builder", 1), 1)
        store.update(queries)
        answers.append(sorted(map(tuple, store.answers().collect())))
    assert answers[0] == answers[1] and len(answers[0]) == 12 * len(queries)


def test_trees_draw_values_of_leaf_records(spark):
    rows = [(d, i, i % 3, i % 4, None if i % 50 == 7 else float(i % 3 * 1000 + i * i % 97)) for d in (0, 1) for i in range(200)]
    tables = spark.createDataFrame(rows, "dataset_id long, record_id long, a long, b long, x double")
    got = Y.synth_sequential_tree(tables, SPEC, 500, 3).toPandas()
    for d in (0, 1):
        seen = {(r[2], r[4]) for r in rows if r[0] == d}
        mine = got[got["dataset_id"] == d]
        drawn = {(r.a, None if np.isnan(r.x) else r.x) for r in mine.itertuples()}
        assert len(mine) == 500 and {x for _, x in drawn} <= {x for _, x in seen}
        # x depends on a: the tree splits on it, so nearly every drawn pair occurs
        share = np.mean([(r.a, None if np.isnan(r.x) else r.x) in seen for r in mine.itertuples()])
        assert share > 0.9
        assert abs(mine["a"].value_counts(normalize=True)[0] - 67 / 200) < 0.08


def test_private_network_spends_its_budget():
    from tablerisk.functions.privacy import PrivacyLedger

    for epsilon in (0.5, 3.0):
        for width in (1, 2, 7):
            ledger, choice, table = Y.private_network_budget(epsilon, width)
            assert ledger.spent == pytest.approx(epsilon)
            assert [n for _, n, _ in ledger.entries] == ([width - 1, width] if width > 1 else [1])
            assert table == ledger.entries[-1][2] and (width == 1 or choice == ledger.entries[0][2])
    ledger = PrivacyLedger(1.0)
    ledger.spend("all", 1.0, 3)
    with pytest.raises(ValueError):
        ledger.spend("more", 0.1, 1)
    with pytest.raises(ValueError):
        PrivacyLedger(0.0)


def test_private_choices_follow_the_budget(spark):
    pairs = [(0, 1, 0.9), (0, 2, 0.05), (0, 3, 0.01), (1, 2, 0.02), (1, 3, 0.6), (2, 3, 0.3)]
    rows = [(d, a, b, mi, 5000) for d in range(200) for a, b, mi in pairs]
    information = spark.createDataFrame(rows, "dataset_id long, a int, b int, mi double, t long")

    def nets(epsilon):
        found = Y.network(information, 4, 1, 1, epsilon).toPandas()
        for _, net in found.groupby("dataset_id"):
            assert sorted(net["child"]) == [0, 1, 2, 3] and all(len(p) == (s > 0) for p, s in zip(net["parents"], net["step"]))
        return {d: tuple(zip(net["child"], map(tuple, net["parents"]))) for d, net in found.groupby("dataset_id")}

    best, rich, poor = nets(None), nets(1e6), nets(1e-6)
    assert rich == best  # without noise each step takes the best pair
    assert sum(poor[d] == best[d] for d in best) < 60 and len(set(poor.values())) > 20


def test_audit_targets_exist_where_no_record_is_unique(spark):
    rows = [(i + 100 * k, i % 3, v) for k in range(2) for i, v in enumerate([0, 0, 0, 1, 0, 0])]
    table = spark.createDataFrame([*rows, (500, 0, 0), (None, 9, 9)], "record_id long, a long, b long")
    assert T.choose_targets(table, ["a", "b"], 1) == [3]  # (0, 1) occurs twice, all others more often
    assert T.choose_targets(table.filter("record_id <> 103"), ["a", "b"], 5) == [3]  # unique ones only, if any


def test_text_features_are_read_once(spark, tmp_path):
    from tablerisk.registry import inputs
    from tablerisk.registry.queries import _fitted

    texts = [f"Row {i}, No. {'é😀' * (i % 3)}{i * 37}!\n" * (1 + i % 4) for i in range(40)] + ["", "A.B,C!D?9"]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    docs.selectExpr("doc_id", "doc_id % 2 quality").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    for r in inputs.document_features(spark, str(tmp_path)).collect():
        text = texts[r.doc_id]
        classes = ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".,!?")
        assert list(r.features[3:]) == [sum(c in k for c in text) / max(len(text), 1) for k in classes]
    scored = _fitted(spark, str(tmp_path), ["logistic_regression"])
    assert not [f for f in scored.inputFiles() if "documents" in f]  # a fit's passes read stored features
