"""One callable (spark, folder) -> DataFrame per operator."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablerisk.functions.durable import checkpoint_folder, durable
from tablerisk.functions.keyed import keyed_hash
from tablerisk.operators import counts as C
from tablerisk.operators import features as X
from tablerisk.operators import metrics as M
from tablerisk.operators import nearest as N
from tablerisk.operators import prep as P
from tablerisk.operators import querysets as S
from tablerisk.operators import sampling as R
from tablerisk.operators import shadow as H
from tablerisk.operators import synthesis as Y
from tablerisk.operators.models import fit_models, population_fitness
from tablerisk.operators.overlay import exact_overlay
from tablerisk.plans.answer_store import AnswerStore, answer_matrix, dataset_labels, members_table
from tablerisk.plans.attribute import attribute_audit, choose_targets
from tablerisk.plans.membership import membership_audit
from tablerisk.plans.query_search import SearchConfig, query_search
from tablerisk.plans.vulnerability import vulnerability_ranking
from tablerisk.registry import inputs as I
from tablerisk.sources.results import resume_targets, run_key, write_results
from tablerisk.sources.tables import ingest_discretized, read_raw
from tablerisk.spec import ID, Mechanism, TableSpec

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Integers as bigint, doubles rounded: the form both engines are compared in."""
    out = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint"):
            column = column.cast("bigint")
        elif kind in ("double", "float"):
            column = F.round(column.cast("double"), digits)
        out.append(column.alias(name))
    return df.select(*out)


# ---- tables -------------------------------------------------------------------------------


@register("load_table")
def q_load_table(spark, folder):
    return I.part(spark, folder)


@register("select_columns")
def q_select_columns(spark, folder):
    return P.select_columns(I.part(spark, folder), I.PART, ["p_type", "p_size"])


@register("target_record")
def q_target_record(spark, folder):
    return P.target_record(I.part(spark, folder), 7)


@register("prepare_table")
def q_prepare_table(spark, folder):
    return rounded(P.prepare_table(I.part(spark, folder), I.PART)[0])


@register("ingest_discretized")
def q_ingest_discretized(spark, folder):
    columns = ["c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"]
    raw = read_raw(spark, [f"{folder}/customer.parquet"], columns, fmt="parquet")
    return rounded(ingest_discretized(raw, "c_custkey"))


@register("discretize")
def q_discretize(spark, folder):
    return rounded(P.discretize(I.part(spark, folder), ["p_brand", "p_type"])[0])


@register("minmax_normalize")
def q_minmax_normalize(spark, folder):
    return rounded(I.scaled_part(spark, folder))


@register("one_hot")
def q_one_hot(spark, folder):
    df = I.read(spark, folder, "orders").select(
        F.col("o_orderkey").alias(ID), "o_orderstatus", "o_orderpriority", "o_totalprice"
    )
    spec = TableSpec(
        ("o_orderstatus", "o_orderpriority"),
        ("o_totalprice",),
        domain={"o_orderstatus": I.STATUS, "o_orderpriority": tuple(p[0] for p in I.PRIORITY)},
    )
    df = df.withColumn("o_orderpriority", F.substring("o_orderpriority", 1, 1))
    return rounded(P.one_hot(df, spec))


@register("split_table")
def q_split_table(spark, folder):
    df = I.customers(spark, folder)
    turn = keyed_hash(2, ID, 3) % 3
    ids = df.select(ID, F.when(turn == 0, "aux").when(turn == 1, "target").alias("split"))
    return P.split_table(df, ids.filter("split is not null"))


@register("random_split")
def q_random_split(spark, folder):
    df = I.customers(spark, folder)
    n = df.count()
    return P.random_split(df, n // 5, n // 2, seed=9)


@register("halve_pool")
def q_halve_pool(spark, folder):
    return P.halve_pool(I.customers(spark, folder))


@register("halve_pool_large_ids")
def q_halve_pool_large_ids(spark, folder):
    return P.halve_pool(I.customers(spark, folder).withColumn(ID, F.col(ID) + F.lit(2**60)))


@register("discretize_large_values")
def q_discretize_large_values(spark, folder):
    big = I.read(spark, folder, "orders").select(
        F.col("o_orderkey").alias(ID), (F.col("o_custkey") + F.lit(2**60)).alias("owner"), F.col("o_totalprice").alias("price")
    )
    return rounded(P.discretize(big, ["owner", "price"])[0])


@register("exclude_identical")
def q_exclude_identical(spark, folder):
    df = I.lines(spark, folder)
    columns = ["l_returnflag", "l_linestatus", "l_quantity", "l_discount"]
    return rounded(P.exclude_identical(df, df.filter("l_linenumber = 7"), columns))


@register("unique_records")
def q_unique_records(spark, folder):
    df = I.read(spark, folder, "lineitem").withColumn(
        ID, F.col("l_orderkey") * 8 + F.col("l_linenumber")
    )
    return P.unique_records(df, ["l_suppkey", "l_returnflag", "l_quantity", "l_discount"])


# ---- sampling and shadow tables -----------------------------------------------------------


@register("sample_per_dataset")
def q_sample_per_dataset(spark, folder):
    df = I.customers(spark, folder)
    n = df.count()
    return R.sample_per_dataset(df, R.dataset_ids(spark, 8), n // 10, 4, pool_size=n)


@register("randomize_sensitive")
def q_randomize_sensitive(spark, folder):
    return rounded(R.randomize_sensitive(I.customers(spark, folder), 8, 6))


@register("exact_shadow")
def q_exact_shadow(spark, folder):
    df = I.customers(spark, folder)
    fixed = R.randomize_sensitive(df, 1, 8).drop("dataset_id")
    return rounded(R.exact_shadow(fixed, 8, 6, 5))


def _halves(spark, folder):
    df = I.customers(spark, folder)
    aux, pool = durable(I.half(df, 11, 1)), durable(I.half(df, 11, 0))
    return df, aux, pool, df.count() // 20


@register("shadow_tables")
def q_shadow_tables(spark, folder):
    _, aux, pool, n = _halves(spark, folder)
    targets = I.one_of_each(pool, "c_nationkey")
    return H.shadow_tables(aux, targets, n, 4, 12)


@register("shadow_tables_specific")
def q_shadow_tables_specific(spark, folder):
    _, _, pool, _ = _halves(spark, folder)
    base = I.half(pool, 18, 1)
    return H.shadow_tables_specific(base, I.one_of_each(base, "c_mktsegment"), pool, 6, 13)


@register("shadow_tables_average")
def q_shadow_tables_average(spark, folder):
    _, aux, pool, n = _halves(spark, folder)
    targets = I.one_of_each(aux, "c_mktsegment")
    return H.shadow_tables_average(pool, targets, n, 4, 14)


@register("target_dataset")
def q_target_dataset(spark, folder):
    df = I.customers(spark, folder)
    n = df.count() // 10
    target = I.one_record(df)
    return rounded(
        H.target_dataset(df, target, I.CUSTOMER_COLUMNS, n, R.dataset_ids(spark, 6), 15)
    )


def _auxiliary(spark, folder, n_datasets=8):
    df = I.customers(spark, folder)
    n = df.count() // 20
    return H.auxiliary_shadow(df, I.one_record(df), I.CUSTOMER_COLUMNS, n, n_datasets, 16)


@register("auxiliary_shadow")
def q_auxiliary_shadow(spark, folder):
    return rounded(_auxiliary(spark, folder))


@register("shadow_summary")
def q_shadow_summary(spark, folder):
    return rounded(H.shadow_summary(_auxiliary(spark, folder), 5))


# ---- nearest neighbours -------------------------------------------------------------------


@register("achilles_scores")
def q_achilles_scores(spark, folder):
    return rounded(I.part_scores(spark, folder))


@register("top_vulnerable")
def q_top_vulnerable(spark, folder):
    return rounded(N.top_vulnerable(I.part_scores(spark, folder), 100))


@register("score_summary")
def q_score_summary(spark, folder):
    return rounded(N.score_summary(I.part_scores(spark, folder)))


@register("score_histogram")
def q_score_histogram(spark, folder):
    return rounded(N.score_histogram(I.part_scores(spark, folder), 100, 20))


@register("vulnerability_report")
def q_vulnerability_report(spark, folder):
    ranked = vulnerability_ranking(I.part(spark, folder), I.PART, k=5, n=50)
    return rounded(ranked.select("rank", F.round("achilles_score", 6).alias("achilles_score")))


def _embedding_similarity(spark, folder):
    df = I.read(spark, folder, "embeddings").select(
        F.col("vec_id").alias(ID), F.col("label").cast("bigint").alias("dataset_id"), "embedding"
    )
    target = P.target_record(df, 0)
    beside = N.with_target(df, target, ["embedding"], "__t_")
    similarity = F.round(N.vector_similarity("embedding", "__t_embedding"), 9)
    return beside.select("dataset_id", ID, similarity.alias("similarity"))


@register("distance_features")
def q_distance_features(spark, folder):
    return rounded(N.distance_features(_embedding_similarity(spark, folder), ["dataset_id"]))


@register("closest_rows")
def q_closest_rows(spark, folder):
    return rounded(N.closest_rows(_embedding_similarity(spark, folder), ["dataset_id"], 50))


# ---- count queries ------------------------------------------------------------------------


def _line_values(df: DataFrame) -> DataFrame:
    """One value row per flag and status: the typical quantity and discount there."""
    groups = df.groupBy("l_returnflag", "l_linestatus").agg(
        F.floor(F.avg("l_quantity")).cast("double").alias("l_quantity"),
        F.round(F.avg("l_discount"), 2).alias("l_discount"),
    )
    number = (F.col("l_returnflag") * 2 + F.col("l_linestatus")).cast("bigint")
    return groups.withColumn("value_id", number)


@register("count_queries")
def q_count_queries(spark, folder):
    df = I.lines(spark, folder)
    lattice = S.query_lattice(spark, I.LINE, [1, 2, 3, 4], (1, -1), (2, 3, -2, -3))
    answers = C.count_queries(
        df, I.LINE.columns, lattice, _line_values(df), int_domain=False
    )
    return answers.select("value_id", "query_id", "cnt")


@register("structured_counts")
def q_structured_counts(spark, folder):
    df = R.randomize_sensitive(I.customers(spark, folder), 1, 8).drop("dataset_id")
    columns = [*I.CUSTOMER_COLUMNS, "sensitive"]
    spec = TableSpec(tuple(columns), ())
    lattice = S.query_lattice(spark, spec, [1, 2, 3, 4], (1, -1))
    answers = C.structured_counts(df, columns, df.select(F.col(ID).alias("user_id")), lattice)
    return answers.select("user_id", "query_id", "cnt")


def _order_counts(spark, folder):
    df = I.orders(spark, folder)
    lattice = S.query_lattice(spark, I.ORDERS, [1, 2, 3], (1, -1), (1, 2, -2))
    values = P.target_record(df, 0).withColumn("value_id", F.lit(0).cast("bigint"))
    return C.count_queries(df, I.ORDERS.columns, lattice, values)


@register("user_set_hash")
def q_user_set_hash(spark, folder):
    return _order_counts(spark, folder).select("query_id", "cnt", "set_hash")


@register("counts_threshold_gaussian")
def q_counts_threshold_gaussian(spark, folder):
    return C.counts_threshold_gaussian(_order_counts(spark, folder), 20, 3.0, 21)


@register("counts_sticky_uniform")
def q_counts_sticky_uniform(spark, folder):
    return C.counts_sticky_uniform(_order_counts(spark, folder), 4, 2, 22)


@register("counts_dp_laplace")
def q_counts_dp_laplace(spark, folder):
    budget = F.lit(1.0) / (F.col("query_id") % 4 + 1)
    counts = _order_counts(spark, folder).withColumn("budget", budget)
    return C.counts_dp_laplace(counts, 0.5, 23)


@register("query_lattice")
def q_query_lattice(spark, folder):
    lattice = S.query_lattice(spark, I.ORDERS, [1, 2, 3], (1, -1), (1, 2, -2), limit=30)
    texts = lattice.select(
        "query_id", "name", S.condition_text(F.col("conditions")).alias("conditions")
    )
    counts = _order_counts(spark, folder).select("query_id", "cnt")
    return texts.join(counts, "query_id")


def _as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("conditions", S.condition_text(F.col("conditions")))


@register("query_multiplicity")
def q_query_multiplicity(spark, folder):
    return rounded(_as_text(S.query_multiplicity(I.query_log(spark, folder))))


@register("query_occurrences")
def q_query_occurrences(spark, folder):
    numbered = S.query_occurrences(I.query_log(spark, folder), "query_id", ["solution_id"])
    return _as_text(numbered)


@register("budget_shares")
def q_budget_shares(spark, folder):
    return rounded(_as_text(S.budget_shares(I.query_log(spark, folder), ["solution_id"])), 9)


@register("difference_query_pairs")
def q_difference_query_pairs(spark, folder):
    pairs, _ = S.difference_query_pairs(I.query_log(spark, folder))
    return rounded(pairs)


@register("unpaired_queries")
def q_unpaired_queries(spark, folder):
    _, rest = S.difference_query_pairs(I.query_log(spark, folder))
    return rest.select(F.col("text").alias("conditions"))


# ---- features -----------------------------------------------------------------------------


@register("query_features")
def q_query_features(spark, folder):
    df = I.events(spark, folder)
    made = X.query_features(df, I.EVENTS, I.event_target(df), [1, 2, 3])
    return rounded(made)


@register("query_features_sparse")
def q_query_features_sparse(spark, folder):
    df = I.events(spark, folder)
    made = X.query_features(df, I.EVENTS, I.event_target(df), [1, 2], (1, -1), (2, -3))
    return rounded(made)


@register("naive_features")
def q_naive_features(spark, folder):
    return rounded(X.naive_features(I.events(spark, folder), I.EVENTS))


@register("correlation_features")
def q_correlation_features(spark, folder):
    return rounded(X.correlation_features(I.events(spark, folder), I.EVENTS))


@register("similarity_features")
def q_similarity_features(spark, folder):
    df = I.events(spark, folder)
    return rounded(X.similarity_features(df, I.EVENTS, I.event_target(df)), 5)


@register("closest_features")
def q_closest_features(spark, folder):
    df = I.events(spark, folder)
    return rounded(X.closest_features(df, I.EVENTS, I.event_target(df), 10))


@register("extract_features")
def q_extract_features(spark, folder):
    df = I.events(spark, folder)
    wanted = ["naive", ("query", (1, 2, 3), None, (1,), (3,)), "correlation"]
    return rounded(X.extract_features(df, I.EVENTS, I.event_target(df), wanted))


def _train_test(spark, folder):
    df = I.events(spark, folder)
    # literals that no record exceeds: the strict comparisons count 0 everywhere
    top = df.agg(F.max("value").alias("value"), F.max("hour").alias("hour"))
    target = top.select(
        F.lit(0).cast("bigint").alias(ID), F.lit(0).alias("event_type"), "value", "hour"
    )
    made = X.query_features(df, I.EVENTS, target, [1, 2], (1, -1), (2, -3))
    return made.filter("dataset_id < 10"), made.filter("dataset_id >= 10")


def _tagged(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.withColumn("phase", F.lit("train")).unionByName(
        test.withColumn("phase", F.lit("eval"))
    )


@register("drop_zero_features")
def q_drop_zero_features(spark, folder):
    return rounded(_tagged(*X.drop_zero_features(*_train_test(spark, folder))))


@register("standardize_features")
def q_standardize_features(spark, folder):
    return rounded(_tagged(*X.standardize_features(*_train_test(spark, folder))))


# ---- synthesis ----------------------------------------------------------------------------


def _order_tables(spark, folder):
    df = I.orders(spark, folder)
    tables = df.withColumn("dataset_id", F.col("o_custkey") % 5).drop("o_custkey")
    return tables, max(df.count() // 10, 1)


@register("synth_independent")
def q_synth_independent(spark, folder):
    tables, size = _order_tables(spark, folder)
    return rounded(Y.synth_independent(tables, I.ORDERS, size, 31))


@register("synth_bayesnet")
def q_synth_bayesnet(spark, folder):
    tables, size = _order_tables(spark, folder)
    return rounded(Y.synth_bayesnet(tables, I.ORDERS, size, 32))


@register("synth_privbayes")
def q_synth_privbayes(spark, folder):
    tables, size = _order_tables(spark, folder)
    return rounded(Y.synth_privbayes(tables, I.ORDERS, size, 33, epsilon=10.0))


@register("synth_sequential_tree")
def q_synth_sequential_tree(spark, folder):
    tables, size = _order_tables(spark, folder)
    return rounded(Y.synth_sequential_tree(tables, I.ORDERS, size, 34))


# ---- models and metrics -------------------------------------------------------------------


def _fitted(spark, folder, models, **params):
    df = durable(I.document_features(spark, folder))  # texts are read once, not by every pass of a fit
    scored = fit_models(
        df.filter("phase = 'train'"), df.filter("phase = 'eval'"), models, seed=1, params=params
    )
    return rounded(scored.select("doc_id", "model", "label", "probability"))


@register("train_logistic")
def q_train_logistic(spark, folder):
    return _fitted(spark, folder, ["logistic_regression"])


@register("train_forest")
def q_train_forest(spark, folder):
    return _fitted(spark, folder, ["random_forest"])


@register("train_mlp")
def q_train_mlp(spark, folder):
    return _fitted(spark, folder, ["mlp"])


@register("fit_models")
def q_fit_models(spark, folder):
    names = ["logistic_regression", "random_forest", "mlp"]
    return M.binary_metrics(durable(_fitted(spark, folder, names)), ["model"])



@register("binary_metrics")
def q_binary_metrics(spark, folder):
    df = I.read(spark, folder, "documents").join(I.read(spark, folder, "labels"), "doc_id")
    scored = df.select("lang", F.col("quality").alias("label"), (F.col("n_chars") / 4000.0).alias("s"))
    return rounded(M.binary_metrics(scored, ["lang"], score="s"))


def _nation_metrics(spark, folder):
    """Two 'models' guessing the market segment, judged per nation."""
    df = I.customers(spark, folder).select(
        F.col("c_nationkey").alias("record_id"),
        (F.col("c_mktsegment") < 2).cast("int").alias("label"),
        (F.col("band") / 10.0).alias("a"),
        ((keyed_hash(5, ID, 3) % 1000) / 1000.0).alias("b"),
    )
    scored = df.select(
        "record_id",
        "label",
        F.explode(
            F.create_map(F.lit("logistic_regression"), "a", F.lit("random_forest"), "b")
        ).alias("model", "probability"),
    )
    return M.binary_metrics(scored, ["record_id", "model"])


@register("audit_results_table")
def q_audit_results_table(spark, folder):
    nested = M.nest_results(_nation_metrics(spark, folder))
    return rounded(M.audit_results_table(nested))


@register("aggregate_targets")
def q_aggregate_targets(spark, folder):
    return rounded(M.aggregate_targets(_nation_metrics(spark, folder), ["accuracy", "auc"]))


@register("write_results")
def q_write_results(spark, folder):
    target = _fresh_folder(spark)
    return rounded(write_results(_nation_metrics(spark, folder), target, ["model"]))



def _fresh_folder(spark) -> str:
    """A new folder for one run's results, on the shared storage if the session names one."""
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="tablerisk-results-")
    name = run_key({"app": spark.sparkContext.applicationId, "folder": tempfile.mktemp()})
    return f"{checkpoint_folder(spark)}/{name}"


@register("resume_targets")
def q_resume_targets(spark, folder):
    target = _fresh_folder(spark)
    metrics = _nation_metrics(spark, folder)
    done = metrics.filter("model = 'random_forest' and accuracy >= 0.5")
    write_results(done, target, ["model"])
    wanted = I.customers(spark, folder).select(F.col("c_nationkey").alias("record_id")).distinct()
    return resume_targets(wanted, target, "record_id")



# ---- attribute audit ----------------------------------------------------------------------

# Sixteen probe queries over (nation, segment, band, sensitive): the sensitive column conditioned
# both ways under every choice of the other three.
PROBES = [
    (a, b, c, s) for a in (0, 1) for b in (0, -1) for c in (0, 1) for s in (1, -1)
]


def _cache(spark, folder, mechanism, stored=None):
    tables = durable(_auxiliary(spark, folder))
    target = I.one_record(I.customers(spark, folder))
    return tables, AnswerStore(tables, [*I.CUSTOMER_COLUMNS, "sensitive"], target, mechanism, 41, stored)


@register("answer_cache")
def q_answer_cache(spark, folder):
    """Two batches of overlapping queries; the second is asked after a restart, by a store opened on the same folder."""
    mechanism, stored = Mechanism("table-builder", threshold=4, c=2), f"{_fresh_folder(spark)}/answers"
    for batch in (PROBES[:10], PROBES[5:]):
        _, cache = _cache(spark, folder, mechanism, stored)
        cache.update({(q, 0) for q in batch})
    return cache.answers()


@register("overlay_answers")
def q_overlay_answers(spark, folder):
    """All probes on 64 versions of the whole table that differ in the target's sensitive bit, kept as one table and 128 rows."""
    df = I.customers(spark, folder)
    fixed = durable(R.randomize_sensitive(df, 1, 8).drop("dataset_id"))
    store = AnswerStore(
        exact_overlay(fixed, 64, 6, 5), [*I.CUSTOMER_COLUMNS, "sensitive"], I.one_record(df),
        Mechanism("table-builder", threshold=4, c=2), 41,
    )
    store.update({(q, 0) for q in PROBES})
    return store.answers()


@register("answer_matrix")
def q_answer_matrix(spark, folder):
    tables, cache = _cache(spark, folder, Mechanism("simple"))
    cache.update({(q, 0) for q in PROBES})
    members = members_table(spark, [[(q, 0) for q in PROBES]])
    matrix = answer_matrix(members, cache.answers(members), dataset_labels(tables, 5))
    text = F.array_join(
        F.transform("features", lambda x: x.cast("bigint").cast("string")), ","
    )
    return rounded(matrix.select("dataset_id", "phase", text.alias("features"), "label"))



@register("population_fitness")
def q_population_fitness(spark, folder):
    tables = durable(_auxiliary(spark, folder, 40))
    target = I.one_record(I.customers(spark, folder))
    cache = AnswerStore(
        tables, [*I.CUSTOMER_COLUMNS, "sensitive"], target, Mechanism("simple"), 42
    )
    cache.update({(q, 0) for q in PROBES})
    solutions = [[(q, 0) for q in PROBES[i : i + 8]] for i in range(8)]
    members = members_table(spark, solutions)
    return rounded(population_fitness(members, cache.rows(members), dataset_labels(tables, 5)))


SMALL_SEARCH = SearchConfig(population_size=8, num_queries=6, num_generations=2, seed=3)


@register("query_search")
def q_query_search(spark, folder):
    tables = durable(_auxiliary(spark, folder, 40))
    target = I.one_record(I.customers(spark, folder))
    columns = [*I.CUSTOMER_COLUMNS, "sensitive"]
    mechanism = Mechanism("table-builder", threshold=4)
    logs = []
    for mode in ("evolutionary", "random"):
        config = SearchConfig(**{**SMALL_SEARCH.__dict__, "mode": mode})
        found = query_search(tables, columns, target, 5, mechanism, config)
        logs.append(found.log().withColumn("mode", F.lit(mode)))
    return rounded(reduce(DataFrame.unionByName, logs))



@register("search_restart")
def q_search_restart(spark, folder):
    """Per generation: solutions of a search that was cut off and continued, how many equal an uncut one's, repeated queries."""
    tables = durable(_auxiliary(spark, folder, 40))
    target = I.one_record(I.customers(spark, folder))
    columns, mechanism = [*I.CUSTOMER_COLUMNS, "sensitive"], Mechanism("simple", scale=1.0)
    cut, whole = f"{_fresh_folder(spark)}/cut", f"{_fresh_folder(spark)}/whole"
    for place, generations in ((cut, 1), (cut, 3), (whole, 3)):
        config = SearchConfig(**{**SMALL_SEARCH.__dict__, "num_generations": generations})
        found = query_search(tables, columns, target, 5, mechanism, config, place)
        if place == cut:
            resumed, store = found.generations.read(), found.store
    keys = ["batch", "rank", "queries", "fitness_train", "fitness_eval", "fitness_min"]
    same = resumed.join(found.generations.read().withColumn("same", F.lit(1)), keys, "left")
    repeated = store.rows().groupBy("query_id", "variant").count().filter("count > 1").count()
    return same.groupBy(F.col("batch").cast("bigint").alias("generation")).agg(
        F.count(F.lit(1)).alias("n_solutions"),
        F.count("same").alias("n_same"),
        F.lit(repeated).cast("bigint").alias("n_repeated"),
    )


@register("attribute_audit")
def q_attribute_audit(spark, folder):
    df = I.customers(spark, folder)
    n = df.count()
    split = P.random_split(df, test_size=n // 2, seed=51)
    columns = list(I.CUSTOMER_COLUMNS)
    targets = choose_targets(split.filter("split = 'test'"), columns, 1)
    return rounded(
        attribute_audit(
            split,
            columns,
            targets,
            Mechanism("table-builder", threshold=4),
            "auxiliary",
            SMALL_SEARCH,
            n_rows=max(n // 20, 5),
            n_datasets=40,
            n_tests=20,
        )
    )



@register("membership_audit")
def q_membership_audit(spark, folder):
    df = I.customers(spark, folder)
    n = df.count()
    turn = keyed_hash(61, ID, 3) % 4
    ids = df.select(ID, F.when(turn < 2, "aux").when(turn == 2, "target").alias("split"))
    split = durable(P.split_table(df, ids.filter("split is not null")))
    targets = I.one_of_each(split.filter("split = 'target'"), "c_mktsegment")
    return rounded(
        membership_audit(
            split,
            I.CUSTOMERS,
            targets,
            synthesizer="indhist",
            n_original=max(n // 20, 5),
            n_synth=max(n // 20, 5),
            n_datasets=20,
            models=("logistic_regression",),
            evaluations=("specific", "average"),
        )
    )

