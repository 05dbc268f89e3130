"""Synthesising tables: all datasets of a long DataFrame at once, keyed by dataset_id.

Every column is first an ordinal *cell*: the code of a category, or the equal-width bin of a
continuous value. Models are tables of cell counts; rows are drawn by inverse distribution lookup
with keyed hashes, and bins turn back into values uniformly inside the bin.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablerisk.functions.durable import broadcast_if_small, durable, stored_side
from tablerisk.functions.keyed import (
    STREAM_NET,
    STREAM_SYNTH,
    laplace,
    mix_int,
    uniform,
    with_hashes,
)
from tablerisk.functions.privacy import PrivacyLedger, information_sensitivity
from tablerisk.functions.ranks import bucketed_rank
from tablerisk.spec import ID, TableSpec

BINS = 20
CHUNK = 50_000


def to_cells(
    tables: DataFrame, spec: TableSpec, bins: int = BINS, extra: Sequence[str] = (), missing_cell: bool = True
) -> tuple[DataFrame, DataFrame]:
    """dataset_id, cells (array<int> in column order) and per-dataset bin edges.

    A category's cell is its place in the declared domain. A continuous column gets ``bins``
    equal-width bins between the dataset's extremes, and a missing value is the cell after them
    (an error without ``missing_cell``).
    """
    continuous = [c for c in spec.columns if c in spec.continuous]
    edges = tables.groupBy("dataset_id").agg(
        F.array(*[F.min(f"`{c}`").cast("double") for c in continuous]).alias("low")
        if continuous
        else F.array().cast("array<double>").alias("low"),
        F.array(*[F.max(f"`{c}`").cast("double") for c in continuous]).alias("high")
        if continuous
        else F.array().cast("array<double>").alias("high"),
        F.count(F.lit(1)).alias("n"),
    )
    edges = durable(edges)
    joined = tables.join(broadcast_if_small(edges), "dataset_id")
    missing = F.lit(bins) if missing_cell else F.raise_error(F.lit("missing values have no private cell")).cast("int")
    cells, at = [], 0
    for c in spec.columns:
        if c in spec.categorical:
            places = F.create_map(
                *[F.lit(x) for k, v in enumerate(spec.domain[c]) for x in (str(v), k)]
            )
            text = F.col(f"`{c}`").cast("string")
            message = F.concat(F.lit(f"unseen category in {c}: "), F.coalesce(text, F.lit("null")))
            cells.append(F.coalesce(places[text], F.raise_error(message).cast("int")))
        else:
            low, high = F.col("low")[at], F.col("high")[at]
            value = F.col(f"`{c}`").cast("double")
            share = F.try_divide(value - low, high - low)
            cell = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins).cast("int"), F.lit(bins - 1))
            cells.append(F.when(value.isNull(), missing).otherwise(cell))
            at += 1
    return joined.select("dataset_id", *extra, F.array(*cells).alias("cells")), edges


def from_cells(
    drawn: DataFrame, edges: DataFrame, spec: TableSpec, bins: int, seed: int
) -> DataFrame:
    """dataset_id, row_no, cells -> dataset_id, row_no, columns."""
    streams, at = {}, 0
    for i, c in enumerate(spec.columns):
        if c in spec.continuous:
            streams[f"__u{i}"] = STREAM_SYNTH + 1000 + i
    joined = drawn.join(broadcast_if_small(edges.select("dataset_id", "low", "high")), "dataset_id")
    joined = with_hashes(joined, seed, ["dataset_id", "row_no"], streams)
    out = []
    for i, c in enumerate(spec.columns):
        cell = F.col("cells")[i]
        if c in spec.categorical:
            values = F.array(*[F.lit(v) for v in spec.domain[c]])
            out.append(F.element_at(values, cell + 1).alias(c))
        else:
            low, high = F.col("low")[at], F.col("high")[at]
            value = low + (cell + uniform(F.col(f"__u{i}"))) * (high - low) / F.lit(float(bins))
            out.append(F.when(cell < F.lit(bins), value).alias(c))
            at += 1
    return joined.select("dataset_id", "row_no", *out)


def row_frames(datasets: DataFrame, size: int) -> DataFrame:
    """row_no 0..size-1 for every dataset; large tables are produced in chunks on many tasks."""
    chunks = -(-size // CHUNK)
    starts = datasets.withColumn(
        "__c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint")))
    )
    if chunks > 1:
        starts = starts.repartition("dataset_id", "__c")
    first = F.col("__c") * CHUNK
    last = F.least(first + F.lit(CHUNK), F.lit(size)) - 1
    return starts.withColumn("row_no", F.explode(F.sequence(first, last))).drop("__c")


def _distribution(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells with running counts as arrays; a group holds at most one domain (or bin list)."""
    packed = counts.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("cell", "n"))).alias("d"), F.sum("n").alias("total")
    )
    packed = packed.filter("total > 0")
    running = F.transform(
        "d",
        lambda e, i: F.aggregate(
            F.slice("d", 1, i + 1), F.lit(0.0), lambda s, x: s + x["n"].cast("double")
        ),
    )
    return packed.select(
        *keys, F.transform("d", lambda e: e["cell"]).alias("values"), running.alias("upto")
    )


def _pick(values: str, upto: str, u: Column) -> Column:
    """Value whose running count first exceeds u * total."""
    level = u * F.element_at(upto, -1)
    below = F.size(F.filter(upto, lambda c: c <= level))
    return F.element_at(values, F.least(below, F.size(values) - 1) + 1)


def column_counts(cells: DataFrame) -> DataFrame:
    """(dataset, column, cell) counts of all columns in one pass."""
    exploded = cells.select("dataset_id", F.posexplode("cells").alias("column", "cell"))
    return exploded.groupBy("dataset_id", "column", "cell").agg(F.count(F.lit(1)).alias("n"))


def synth_independent(
    tables: DataFrame, spec: TableSpec, size: int, seed: int, bins: int = BINS
) -> DataFrame:
    """Draw every column from its own histogram -> dataset_id, row_no, columns."""
    cells, edges = to_cells(tables, spec, bins)
    marginals = _distribution(column_counts(cells), ["dataset_id", "column"])
    packed = marginals.groupBy("dataset_id").agg(
        F.map_from_entries(
            F.collect_list(F.struct("column", F.struct("values", "upto")))
        ).alias("m")
    )
    packed = durable(packed)
    rows = row_frames(packed.select("dataset_id"), size)
    streams = {f"__h{i}": STREAM_SYNTH + i for i in range(len(spec.columns))}
    hashed = with_hashes(rows, seed, ["dataset_id", "row_no"], streams)
    joined = hashed.join(broadcast_if_small(packed), "dataset_id")
    for i in range(len(spec.columns)):
        joined = joined.withColumn(f"__v{i}", F.col("m")[F.lit(i)]["values"]).withColumn(
            f"__t{i}", F.col("m")[F.lit(i)]["upto"]
        )
    picks = [_pick(f"__v{i}", f"__t{i}", uniform(F.col(f"__h{i}"))) for i in range(len(spec.columns))]
    drawn = joined.select("dataset_id", "row_no", F.array(*picks).alias("cells"))
    return from_cells(drawn, edges, spec, bins, seed)


def pair_information(cells: DataFrame) -> DataFrame:
    """Mutual information of every column pair per dataset -> dataset_id, a, b, mi (a < b)."""
    width = F.size("cells")
    pairs = F.flatten(
        F.transform(
            F.sequence(F.lit(0), width - 2),
            lambda i: F.transform(
                F.sequence(i + 1, width - 1),
                lambda j: F.struct(
                    i.alias("a"),
                    j.alias("b"),
                    F.get("cells", i).alias("x"),
                    F.get("cells", j).alias("y"),
                ),
            ),
        )
    )
    joint = (
        cells.filter(width > 1)
        .select("dataset_id", F.explode(pairs).alias("p"))
        .groupBy("dataset_id", "p.a", "p.b", "p.x", "p.y")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # joint cells are bounded by the product of two domains, so these windows stay small
    by_pair = Window.partitionBy("dataset_id", "a", "b")
    by_x = Window.partitionBy("dataset_id", "a", "b", "x")
    by_y = Window.partitionBy("dataset_id", "a", "b", "y")
    whole = joint.select(
        "*",
        F.sum("n").over(by_pair).alias("t"),
        F.sum("n").over(by_x).alias("nx"),
        F.sum("n").over(by_y).alias("ny"),
    )
    part = F.col("n") / F.col("t") * F.log(
        F.col("n").cast("double") * F.col("t") / (F.col("nx").cast("double") * F.col("ny"))
    )
    return whole.groupBy("dataset_id", "a", "b").agg(F.sum(part).alias("mi"), F.max("t").alias("t"))


def network(
    information: DataFrame, n_columns: int, max_parents: int, seed: int, epsilon: float | None
) -> DataFrame:
    """Greedy structure per dataset -> dataset_id, step, child, parents.

    The first column is drawn; then columns join one by one. Without ``epsilon`` the one with the largest information with
    a placed column comes first, and its parents are the ``max_parents`` best placed columns. Otherwise each step is one
    choice by the exponential mechanism among all pairs of an open column and a set of placed ones, by their mean information, and
    spends ``epsilon``; every candidate of every step has noise of its own. A group holds one row per column pair.
    """

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        dataset = int(group["dataset_id"].iloc[0])
        score = np.full((n_columns, n_columns), -np.inf)
        a, b = group["a"].to_numpy(), group["b"].to_numpy()
        score[a, b] = score[b, a] = group["mi"].to_numpy()
        rng = np.random.default_rng([seed, dataset])
        placed = [mix_int(mix_int(seed + 1) + dataset + 1) % n_columns]
        steps = [(0, placed[0], [])]
        while len(placed) < n_columns:
            open_ = [c for c in range(n_columns) if c not in placed]
            if epsilon is None:
                child = max(open_, key=lambda c: (score[c, placed].max(), -c))
                parents = sorted(placed, key=lambda p: (-score[child, p], p))[:max_parents]
            else:
                sets = list(combinations(sorted(placed), min(max_parents, len(placed))))
                utility = np.stack([score[open_][:, s].mean(axis=1) for s in sets], axis=1)
                scale = 2 * information_sensitivity(float(group["t"].max())) / epsilon
                best = int(np.argmax(utility + scale * rng.gumbel(size=utility.shape)))
                child, parents = open_[best // len(sets)], list(sets[best % len(sets)])
            steps.append((len(placed), child, sorted(parents)))
            placed.append(child)
        return pd.DataFrame(
            {
                "dataset_id": [dataset] * n_columns,
                "step": [s[0] for s in steps],
                "child": [s[1] for s in steps],
                "parents": [s[2] for s in steps],
            }
        )

    schema = "dataset_id bigint, step int, child int, parents array<int>"
    return information.groupBy("dataset_id").applyInPandas(grow, schema)


def private_network_budget(epsilon: float, n_columns: int) -> tuple[PrivacyLedger, float, float]:
    """The ledger of a private network, and what one structure choice and one table of counts may spend.

    Half goes to the choices of all columns but the first, half to the tables of all columns; a single column
    leaves everything to its table.
    """
    ledger, choices = PrivacyLedger(epsilon), n_columns - 1
    choice = ledger.spend("structure choice", epsilon / 2, choices) if choices else math.inf
    return ledger, choice, ledger.spend("table of counts", epsilon - ledger.spent, n_columns)


def synth_bayesnet(
    tables: DataFrame,
    spec: TableSpec,
    size: int,
    seed: int,
    max_parents: int = 2,
    bins: int = BINS,
    epsilon: float | None = None,
) -> DataFrame:
    """Bayesian-network synthesis; with ``epsilon`` structure and counts are differentially private.

    Columns are drawn in network order by equi-joins on (dataset, column, parent cells). Parent
    combinations never seen fall back to the column's own histogram.
    """
    width = len(spec.columns)
    cells, edges = to_cells(tables, spec, bins, missing_cell=epsilon is None)
    cells = durable(cells)
    if epsilon is not None:
        _, choice, table = private_network_budget(epsilon, width)
    if width == 1:
        datasets = cells.select("dataset_id").distinct()
        nets = datasets.select(
            "dataset_id",
            F.lit(0).alias("step"),
            F.lit(0).alias("child"),
            F.array().cast("array<int>").alias("parents"),
        )
    else:
        nets = network(pair_information(cells), width, max_parents, seed, None if epsilon is None else choice)
    nets = durable(nets)
    key = F.array_join(F.transform("parents", lambda p: F.get("cells", p).cast("string")), ",")
    links = cells.join(broadcast_if_small(nets), "dataset_id").select(
        "dataset_id", "child", key.alias("key"), F.get("cells", F.col("child")).alias("cell")
    )
    counts = links.groupBy("dataset_id", "child", "key", "cell").agg(F.count(F.lit(1)).alias("n"))
    marginal = column_counts(cells).withColumnRenamed("column", "child")
    if epsilon is not None:
        counts = _noisy_counts(counts, nets, spec, bins, seed, table)
        marginal = counts.groupBy("dataset_id", "child", "cell").agg(F.sum("n").alias("n"))
    tables_given = durable(_distribution(counts, ["dataset_id", "child", "key"]))
    alone = _distribution(marginal, ["dataset_id", "child"]).withColumnsRenamed(
        {"values": "m_values", "upto": "m_upto"}
    )
    steps = durable(nets.join(alone, ["dataset_id", "child"]))
    sizes = _domain_sizes(spec, bins)
    blank = F.array(*[F.lit(0)] * width)
    drawn = row_frames(nets.select("dataset_id").distinct(), size).withColumn("cells", blank)
    for step in range(width):
        here = steps.filter(F.col("step") == step).drop("step")
        at = drawn.join(broadcast_if_small(here), "dataset_id").withColumn("key", key)
        at = at.join(tables_given, ["dataset_id", "child", "key"], "left")
        at = with_hashes(at, seed, ["dataset_id", "row_no"], {"__h": STREAM_SYNTH + 100 + step})
        values = F.coalesce("values", "m_values")
        upto = F.coalesce("upto", "m_upto")
        at = at.withColumn("__values", values).withColumn("__upto", upto)
        u = uniform(F.col("__h"))
        # noise can empty a whole column: then every cell of the domain is equally likely
        anything = F.floor(u * F.element_at(sizes, F.col("child") + 1)).cast("int")
        at = at.withColumn("__pick", F.coalesce(_pick("__values", "__upto", u), anything))
        placed = F.transform(
            "cells", lambda c, i: F.when(i == F.col("child"), F.col("__pick")).otherwise(c)
        )
        drawn = at.select("dataset_id", "row_no", placed.alias("cells"))
    return from_cells(drawn, edges, spec, bins, seed)


def _domain_sizes(spec: TableSpec, bins: int) -> Column:
    return F.array(
        *[F.lit(len(spec.domain[c]) if c in spec.categorical else bins) for c in spec.columns]
    )


def _noisy_counts(
    counts: DataFrame, nets: DataFrame, spec: TableSpec, bins: int, seed: int, epsilon: float
) -> DataFrame:
    """Laplace noise on every cell of every joint domain, empty cells included; negatives -> 0.

    Each column's table spends ``epsilon``; a replaced record moves two of its cells by one.
    """
    sizes = _domain_sizes(spec, bins)

    def every(column: Column) -> Column:
        return F.sequence(F.lit(0), F.element_at(sizes, column + 1) - 1)

    # all parent combinations: one text key per point of the parents' joint domain
    keys = F.aggregate(
        "parents",
        F.array(F.lit("")),
        lambda done, p: F.flatten(
            F.transform(
                done,
                lambda k: F.transform(
                    every(p),
                    lambda v: F.when(k == "", v.cast("string")).otherwise(
                        F.concat(k, F.lit(","), v.cast("string"))
                    ),
                ),
            )
        ),
    )
    grid = nets.select("dataset_id", "child", F.explode(keys).alias("key"))
    grid = grid.select("dataset_id", "child", "key", F.explode(every(F.col("child"))).alias("cell"))
    joint = grid.join(counts, ["dataset_id", "child", "key", "cell"], "left")
    place = "xxhash64(child, key, cell)"
    hashed = with_hashes(joint, seed, ["dataset_id", place], {"__h": STREAM_NET})
    scale = F.lit(2.0 / epsilon)
    noisy = F.coalesce(F.col("n"), F.lit(0)) + laplace(F.col("__h")) * scale
    return hashed.select(
        "dataset_id", "child", "key", "cell", F.greatest(noisy, F.lit(0.0)).alias("n")
    )


def synth_privbayes(
    tables: DataFrame,
    spec: TableSpec,
    size: int,
    seed: int,
    epsilon: float,
    max_parents: int = 2,
    bins: int = BINS,
) -> DataFrame:
    """Differentially private Bayesian network; ``private_network_budget`` says what spends epsilon.

    Tables that differ in one replaced record are neighbours, so their size is public. The bin edges of continuous columns are the data's own extremes and not covered by epsilon.
    """
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    return synth_bayesnet(tables, spec, size, seed, max_parents, bins, epsilon)


def synth_sequential_tree(
    tables: DataFrame,
    spec: TableSpec,
    size: int,
    seed: int,
    max_depth: int = 3,
    min_leaf: int = 5,
    bins: int = BINS,
) -> DataFrame:
    """Each column from a classification tree on the columns before it.

    The trees of all datasets grow together, one level per pass: records report (dataset, node,
    feature, cell, child cell) counts with map-side combining, the best Gini split of every node is
    found on those counts, and records move down by a join on the node. Drawn rows walk the same
    splits and take the value of a record of their leaf, so only values that occur are drawn: the leaf's records
    are ranked by id, and a row's hash picks a rank, which an equi-join turns into the donor.
    """
    cells, _ = to_cells(tables, spec, bins, [ID, *spec.columns])
    cells = durable(cells)
    datasets = cells.select("dataset_id").distinct()
    drawn = row_frames(datasets, size).withColumn("cells", F.array().cast("array<int>"))
    leaf = ["dataset_id", "node"]
    for child, column in enumerate(spec.columns):
        records = cells.select(
            "dataset_id",
            ID,
            F.col(f"`{column}`").alias("value"),
            F.slice("cells", 1, child).alias("cells") if child else F.array().cast("array<int>").alias("cells"),
            F.get("cells", F.lit(child)).alias("y"),
            F.lit(1).cast("bigint").alias("node"),
        )
        drawn = drawn.withColumn("node", F.lit(1).cast("bigint"))
        for _ in range(max_depth if child else 0):
            splits = durable(_best_splits(records, min_leaf))
            if splits.isEmpty():
                break
            records = _descend(records, splits)
            drawn = _descend(drawn, splits)
        sizes = stored_side(records.groupBy(*leaf).agg(F.count(F.lit(1)).alias("n")))
        donors = bucketed_rank(records.select(*leaf, ID, "value", "y"), leaf, F.shiftright(ID, 16), [F.col(ID)], "rank")
        at = drawn.join(sizes, leaf)
        at = with_hashes(at, seed, ["dataset_id", "row_no"], {"__h": STREAM_SYNTH + 200 + child})
        rank = F.least(F.floor(uniform(F.col("__h")) * F.col("n")), F.col("n") - 1)
        at = at.withColumn("rank", rank.cast("bigint")).join(donors.drop(ID), [*leaf, "rank"])
        kept = [c for c in drawn.columns if c not in ("node", "cells")]
        longer = F.concat("cells", F.array("y")).alias("cells")
        drawn = durable(at.select(*kept, longer, F.col("value").alias(f"__v{child}")))
    values = [F.col(f"__v{i}").alias(c) for i, c in enumerate(spec.columns)]
    return drawn.select("dataset_id", "row_no", *values)


def _best_splits(records: DataFrame, min_leaf: int) -> DataFrame:
    """Best "feature <= cell" split per node -> dataset_id, node, feature, cut."""
    node = ["dataset_id", "node"]
    counts = (
        records.select(*node, F.posexplode("cells").alias("feature", "x"), "y")
        .groupBy(*node, "feature", "x", "y")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # everything below runs on counts: at most features x cells x cells rows per node
    by_y = Window.partitionBy(*node, "feature", "y")
    upto = by_y.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ys = counts.groupBy(*node, "feature", "y").agg(F.sum("n").alias("all"))
    xs = counts.select(*node, "feature", "x").distinct()
    dense = ys.join(xs, [*node, "feature"]).join(counts, [*node, "feature", "x", "y"], "left")
    left = dense.withColumn("l", F.sum(F.coalesce("n", F.lit(0))).over(upto))
    scored = left.groupBy(*node, "feature", F.col("x").alias("cut")).agg(
        F.sum("l").alias("nl"),
        F.sum(F.col("all") - F.col("l")).alias("nr"),
        F.sum((F.col("l") * F.col("l")).cast("double")).alias("sl"),
        F.sum(((F.col("all") - F.col("l")) * (F.col("all") - F.col("l"))).cast("double")).alias("sr"),
        F.sum((F.col("all") * F.col("all")).cast("double")).alias("s"),
    )
    total = F.col("nl") + F.col("nr")
    # Gini gain times node size
    gain = (
        F.try_divide(F.col("sl"), F.col("nl"))
        + F.try_divide(F.col("sr"), F.col("nr"))
        - F.col("s") / total
    )
    usable = scored.filter((F.col("nl") >= min_leaf) & (F.col("nr") >= min_leaf))
    usable = usable.withColumn("gain", gain).filter("gain > 1e-9")
    best = F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("cut")).alias("c")))
    return (
        usable.groupBy(*node)
        .agg(best.alias("b"))
        .select(*node, (-F.col("b.f")).alias("feature"), (-F.col("b.c")).alias("cut"))
    )


def _descend(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Move rows to the child node; rows whose node was not split stay."""
    joined = rows.join(broadcast_if_small(splits), ["dataset_id", "node"], "left")
    right = (F.get("cells", F.col("feature")) > F.col("cut")).cast("int")
    moved = F.when(F.col("feature").isNull(), F.col("node")).otherwise(F.col("node") * 2 + right)
    others = [c for c in rows.columns if c != "node"]
    return joined.select(*others, moved.alias("node"))


def _identity(tables: DataFrame, spec: TableSpec, size: int, seed: int) -> DataFrame:
    return tables.select("dataset_id", F.col(ID).alias("row_no"), *spec.columns)


SYNTHESIZERS = {
    "identity": _identity,
    "indhist": synth_independent,
    "baynet": synth_bayesnet,
    "privbayes": synth_privbayes,
    "synthpop": synth_sequential_tree,
}


def synthesize(
    tables: DataFrame, spec: TableSpec, name: str, size: int, seed: int, epsilon: float | None = None
) -> DataFrame:
    """Run the named synthesizer -> dataset_id, row_no, columns."""
    name = name.lower()
    if name not in SYNTHESIZERS:
        raise ValueError(f"unknown synthesizer {name!r}")
    if name == "privbayes":
        if epsilon is None:
            raise ValueError("privbayes needs epsilon")
        return synth_privbayes(tables, spec, size, seed, epsilon)
    return SYNTHESIZERS[name](tables, spec, size, seed)
