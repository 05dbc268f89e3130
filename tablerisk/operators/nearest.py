"""Nearest-neighbour vulnerability scores and similarity features.

The distance of two records over n = n_cat + n_cont attributes is
``(n_cat - matches)/n + (n_cont/n) * (1 - cosine(continuous))``; a zero continuous vector has
cosine 0 with everything, itself included.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablerisk.functions.durable import durable
from tablerisk.functions.ranks import grouped_quantile, value_rank
from tablerisk.operators.prep import single_record
from tablerisk.spec import ID, TableSpec

MAX_CELLS = 16384
CELL_ROWS = 2048
BLOCK_ROWS = 8192
SLABS = 1024
SLACK = 1e-9


def achilles_scores(
    df: DataFrame,
    spec: TableSpec,
    k: int = 5,
    max_cells: int = MAX_CELLS,
    cell_rows: int = CELL_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Mean of the k smallest distances from each record to all records (itself included).

    Exact, without comparing all pairs: equal records are merged with a weight; the merged records
    are put into cells with known bounds; every record first finds its k nearest inside its own
    cell, and then visits only those other cells whose lower bound beats the k-th distance found.
    Visitors and cell contents both travel in blocks of bounded size, so a crowded cell becomes
    many tasks.
    """
    attributes = [*spec.categorical, *spec.continuous]
    points = durable(_weighted_points(df, spec))
    points = durable(_with_cells(points, spec, max_cells, cell_rows))
    cells = durable(_cell_bounds(points, spec))
    own = points.select("point", "cell", F.lit(float("inf")).alias("limit"), "cats", "unit")
    own_size = cells.select("cell", F.col("rows").alias("guests"), "rows")
    first = durable(_nearest_in_cells(own, points, own_size, spec, k, block_rows))
    # k-th distance so far; infinite while fewer than k records are known
    reach = F.when(F.size("best") >= k, F.element_at("best", k)).otherwise(float("inf"))
    seekers = points.join(first.select("point", reach.alias("limit")), "point")
    visits = durable(_visits(seekers, cells, spec))
    crowd = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("guests"))
    crowd = crowd.join(F.broadcast(cells.select("cell", "rows")), "cell")
    second = _nearest_in_cells(visits, points, crowd, spec, k, block_rows)
    best = _merge_best(first.unionByName(second), k)
    mean = F.aggregate("best", F.lit(0.0), lambda a, d: a + d) / F.size("best")
    scored = points.join(best.select("point", mean.alias("achilles_score")), "point")
    scored = scored.select(*attributes, "achilles_score")
    match = reduce(
        lambda a, b: a & b, [F.col(f"l.`{c}`").eqNullSafe(F.col(f"s.`{c}`")) for c in attributes]
    )
    return df.alias("l").join(scored.alias("s"), match).select(f"l.{ID}", "s.achilles_score")


def _weighted_points(df: DataFrame, spec: TableSpec) -> DataFrame:
    """One row per distinct record: multiplicity, an id, cats (text), unit (continuous direction).

    A missing continuous value, null or NaN, is 0 in the direction; the others keep theirs. A missing category is one more.
    """
    attributes = [*spec.categorical, *spec.continuous]
    counted = df.groupBy(*attributes).agg(
        F.count(F.lit(1)).alias("weight"), F.min(ID).alias("point")
    )
    zero = F.lit(0.0)
    values = [F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), zero), zero) for c in spec.continuous]
    norm = F.sqrt(reduce(lambda a, b: a + b, [v * v for v in values])) if values else zero
    unit = [F.when(norm > 0, v / norm).otherwise(0.0) for v in values]
    cats = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan")) for c in spec.categorical]
    return counted.select(
        "*",
        (F.array(*cats) if cats else F.array().cast("array<string>")).alias("cats"),
        (F.array(*unit) if unit else F.array().cast("array<double>")).alias("unit"),
    )


def _with_cells(points: DataFrame, spec: TableSpec, max_cells: int, cell_rows: int) -> DataFrame:
    """Add cell: a prefix of categorical values, cut into slabs along one direction.

    There are at most about 2 * max_cells cells. A frequent prefix gets proportionally more slabs.
    """
    n_cat, n_cont = len(spec.categorical), len(spec.continuous)
    stats = points.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.approx_count_distinct(F.col("cats")[i]).alias(f"d{i}") for i in range(n_cat)],
        *[F.stddev_pop(F.col("unit")[i]).alias(f"s{i}") for i in range(n_cont)],
    ).first()
    # split on as many categorical columns as the cell budget allows, fewest values first
    split_on, product = [], 1
    budget = max(2, min(max_cells, stats["n"] // cell_rows + 1))
    for i in sorted(range(n_cat), key=lambda i: (stats[f"d{i}"], i)):
        product *= max(stats[f"d{i}"], 1)
        if product > budget:
            break
        split_on.append(i)
    prefix = F.concat_ws("\x1f", *[F.col("cats")[i] for i in split_on]) if split_on else F.lit("")
    points = points.withColumn("prefix", prefix)
    slab = F.lit(0)
    if n_cont and stats["n"] > cell_rows:
        target = max(cell_rows, stats["n"] // max_cells)
        axis = max(range(n_cont), key=lambda i: (stats[f"s{i}"] or 0.0, -i))
        points = points.withColumn("along", F.col("unit")[axis])
        shares = ", ".join(f"{i / SLABS!r}D" for i in range(1, SLABS))
        edges = points.groupBy("prefix").agg(
            F.expr(f"percentile_approx(along, array({shares}), {20 * SLABS})").alias("fine"),
            F.greatest(F.floor(F.lit(target * SLABS) / F.count(F.lit(1))), F.lit(1)).alias("step"),
        )
        kept = F.array_distinct(F.filter("fine", lambda e, i: (i + 1) % F.col("step") == 0))
        edges = F.broadcast(edges.select("prefix", kept.alias("edges")))  # at most max_cells rows
        points = points.join(edges, "prefix")
        slab = F.size(F.filter("edges", lambda e: e < F.col("along")))
    return points.withColumn("cell", F.xxhash64("prefix", slab)).drop("along", "edges")


def _cell_bounds(points: DataFrame, spec: TableSpec) -> DataFrame:
    """Per cell: size, the box of unit vectors, and each categorical value all members share."""
    low, high, shared = [], [], []
    for i in range(len(spec.continuous)):
        low.append(F.min(F.col("unit")[i]))
        high.append(F.max(F.col("unit")[i]))
    for i in range(len(spec.categorical)):
        one = F.col("cats")[i]
        shared.append(F.when(F.min(one) == F.max(one), F.min(one)))
    return points.groupBy("cell").agg(
        F.count(F.lit(1)).alias("rows"),
        (F.array(*low) if low else F.array().cast("array<double>")).alias("low"),
        (F.array(*high) if high else F.array().cast("array<double>")).alias("high"),
        (F.array(*shared) if shared else F.array().cast("array<string>")).alias("shared"),
    )


def _lower_bound(spec: TableSpec) -> Column:
    """Smallest possible distance from a record (cats, unit) to a cell (shared, low, high)."""
    n_cat, n_cont = len(spec.categorical), len(spec.continuous)
    n = n_cat + n_cont
    differ = F.lit(0)
    for i in range(n_cat):
        other = F.col("shared")[i].isNotNull() & (F.col("shared")[i] != F.col("cats")[i])
        differ = differ + other.cast("int")
    gaps = F.lit(0.0)
    for i in range(n_cont):
        x = F.col("unit")[i]
        gap = F.greatest(F.col("low")[i] - x, x - F.col("high")[i], F.lit(0.0))
        gaps = gaps + gap * gap
    # for unit vectors 1 - cos = |u - v|^2 / 2; a zero vector is farther than that
    return differ / F.lit(float(n)) + F.lit(n_cont / n) * gaps / F.lit(2.0)


def _visits(seekers: DataFrame, cells: DataFrame, spec: TableSpec) -> DataFrame:
    """(record, other cell) pairs that may still hold a nearer neighbour.

    Cells are paired first (their number is bounded, not the rows'), using the box of the seekers'
    cell and the largest open distance in it; records then test the remaining cells one by one.
    """
    reach = seekers.groupBy("cell").agg(F.max("limit").alias("reach"))
    home = cells.join(reach, "cell").select(
        F.col("cell").alias("home"),
        "reach",
        F.col("low").alias("h_low"),
        F.col("high").alias("h_high"),
        F.col("shared").alias("h_shared"),
    )
    n_cat, n_cont = len(spec.categorical), len(spec.continuous)
    n = n_cat + n_cont
    differ, gaps = F.lit(0), F.lit(0.0)
    for i in range(n_cat):
        apart = F.col("h_shared")[i] != F.col("shared")[i]
        differ = differ + F.coalesce(apart, F.lit(False)).cast("int")
    for i in range(n_cont):
        gap = F.greatest(
            F.col("low")[i] - F.col("h_high")[i], F.col("h_low")[i] - F.col("high")[i], F.lit(0.0)
        )
        gaps = gaps + gap * gap
    bound = differ / F.lit(float(n)) + F.lit(n_cont / n) * gaps / F.lit(2.0)
    near = (F.col("home") != F.col("cell")) & (bound < F.col("reach") + F.lit(SLACK))
    pairs = home.join(F.broadcast(cells), near).select(
        "home", F.col("cell").alias("visit"), "low", "high", "shared"
    )
    asked = seekers.join(pairs, F.col("cell") == F.col("home"))
    asked = asked.filter(_lower_bound(spec) < F.col("limit") + F.lit(SLACK))
    return asked.select("point", F.col("visit").alias("cell"), "limit", "cats", "unit")


def _nearest_in_cells(
    visitors: DataFrame,
    points: DataFrame,
    crowd: DataFrame,
    spec: TableSpec,
    k: int,
    block_rows: int,
) -> DataFrame:
    """Up to k smallest distances below ``limit`` per visitor within its cell -> point, best.

    ``crowd`` gives the visitors (guests) and the records (rows) of every visited cell.
    """

    def blocks(rows: str) -> Column:
        return F.ceil(F.col(rows) / F.lit(block_rows)).cast("int")

    # one row per cell, and cells are bounded by max_cells
    shape = F.broadcast(
        crowd.select("cell", blocks("guests").alias("n_guest"), blocks("rows").alias("n_home"))
    )
    salt = F.pmod(F.xxhash64("point"), F.col("n_guest")).cast("int")
    every_home = F.explode(F.sequence(F.lit(0), F.col("n_home") - 1))
    left = visitors.join(shape, "cell").select(
        "cell", salt.alias("guest"), every_home.alias("home"), "point", "limit", "cats", "unit"
    )
    own_salt = F.pmod(F.xxhash64("point"), F.col("n_home")).cast("int")
    every_guest = F.explode(F.sequence(F.lit(0), F.col("n_guest") - 1))
    right = points.join(shape, "cell").select(
        "cell", every_guest.alias("guest"), own_salt.alias("home"), "weight", "cats", "unit"
    ).toDF("h_cell", "h_guest", "h_home", "weight", "h_cats", "h_unit")
    keys = ["cell", "guest", "home"]
    n_cat, n_cont = len(spec.categorical), len(spec.continuous)

    def nearest(guests: pd.DataFrame, homes: pd.DataFrame) -> pd.DataFrame:
        return _block_nearest(guests, homes, n_cat, n_cont, k)

    partial = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*[f"h_{key}" for key in keys]))
        .applyInPandas(nearest, "point bigint, best array<double>")
    )
    return _merge_best(partial, k)


def _block_nearest(
    guests: pd.DataFrame, homes: pd.DataFrame, n_cat: int, n_cont: int, k: int
) -> pd.DataFrame:
    """k smallest distances (with multiplicity) of each guest to one block of records."""
    if guests.empty or homes.empty:
        return pd.DataFrame({"point": np.array([], dtype="int64"), "best": pd.Series([], dtype=object)})
    n = n_cat + n_cont
    weights = np.minimum(homes["weight"].to_numpy(), k)
    m = len(homes)
    codes = []
    for i in range(n_cat):
        both = pd.concat([guests["cats"].str[i], homes["h_cats"].str[i]], ignore_index=True)
        codes.append(pd.factorize(both)[0])
    g_unit = h_unit = None
    if n_cont:
        g_unit = np.array(guests["unit"].tolist(), dtype=float)
        h_unit = np.array(homes["h_unit"].tolist(), dtype=float)
    limits = guests["limit"].to_numpy()
    ids = guests["point"].to_numpy()
    points, best = [], []
    keep = min(k, m)
    for start in range(0, len(guests), 512):
        rows = slice(start, min(start + 512, len(guests)))
        size = rows.stop - rows.start
        distance = np.zeros((size, m))
        for code in codes:
            distance += code[rows, None] != code[None, len(guests) :]
        distance /= n
        if n_cont:
            distance += (n_cont / n) * (1.0 - g_unit[rows] @ h_unit.T)
        near = np.argpartition(distance, keep - 1, axis=1)[:, :keep]
        near_d = np.take_along_axis(distance, near, axis=1)
        order = np.argsort(near_d, axis=1)
        near_d = np.take_along_axis(near_d, order, axis=1)
        near_w = weights[np.take_along_axis(near, order, axis=1)]
        for i in range(size):
            found = np.repeat(near_d[i], near_w[i])[:k]
            found = found[found <= limits[rows.start + i]]
            if len(found):
                points.append(ids[rows.start + i])
                best.append(np.maximum(found, 0.0))
    return pd.DataFrame(
        {"point": np.array(points, dtype="int64"), "best": pd.Series(best, dtype=object)}
    )


def _merge_best(partial: DataFrame, k: int) -> DataFrame:
    """The k smallest of all partial lists of a record; at most k per visited block."""
    merged = partial.groupBy("point").agg(F.flatten(F.collect_list("best")).alias("all"))
    return merged.select("point", F.slice(F.array_sort("all"), 1, k).alias("best"))


def top_vulnerable(scores: DataFrame, n: int) -> DataFrame:
    """The n highest scores -> record_id, achilles_score, rank (ties by id)."""
    top = scores.orderBy(F.desc("achilles_score"), ID).limit(n)
    order = Window.orderBy(F.desc("achilles_score"), ID)  # at most n rows are left
    return top.withColumn("rank", F.row_number().over(order))


def score_summary(scores: DataFrame) -> DataFrame:
    """mean_score, third quartile, and percent of scores strictly below the mean."""
    q3 = grouped_quantile(scores, [], "achilles_score", 0.75, "q3")
    mean = scores.agg(F.avg("achilles_score").alias("mean_score"))
    below = scores.join(F.broadcast(mean), F.lit(True)).agg(  # exactly one row
        F.max("mean_score").alias("mean_score"),
        (F.avg((F.col("achilles_score") < F.col("mean_score")).cast("double")) * 100.0).alias(
            "pct_below_mean"
        ),
    )
    return below.join(q3, F.lit(True)).select("mean_score", "q3", "pct_below_mean")


def score_histogram(scores: DataFrame, n: int, bins: int) -> DataFrame:
    """Share of records per score bin, labelled High (at or above the n-th score) or Low."""
    cut = scores.orderBy(F.desc("achilles_score")).limit(n).agg(
        F.min("achilles_score").alias("threshold")
    )
    ends = scores.agg(
        F.min("achilles_score").alias("low"),
        F.max("achilles_score").alias("high"),
        F.count(F.lit(1)).alias("total"),
    )
    side = cut.join(ends, F.lit(True))
    share = F.try_divide(F.col("achilles_score") - F.col("low"), F.col("high") - F.col("low"))
    place = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    label = F.when(F.col("achilles_score") < F.col("threshold"), "Low").otherwise("High")
    return (
        scores.join(F.broadcast(side), F.lit(True))  # exactly one row
        .select(place.alias("bin"), label.alias("label"), "total")
        .groupBy("bin", "label")
        .agg((F.count(F.lit(1)) / F.max("total")).alias("probability"))
    )


def record_similarity(spec: TableSpec, prefix: str) -> Column:
    """Cosine of two records over continuous + one-hot columns, target columns under ``prefix``.

    One-hot blocks are never built: their product is the number of equal categories.
    """
    dot, mine, other = F.lit(0.0), F.lit(float(len(spec.categorical))), F.lit(
        float(len(spec.categorical))
    )
    for c in spec.continuous:
        x, t = F.col(f"`{c}`").cast("double"), F.col(f"`{prefix}{c}`").cast("double")
        dot, mine, other = dot + x * t, mine + x * x, other + t * t
    for c in spec.categorical:
        dot = dot + (F.col(f"`{c}`") == F.col(f"`{prefix}{c}`")).cast("double")
    return F.coalesce(F.try_divide(dot, F.sqrt(mine) * F.sqrt(other)), F.lit(0.0))


def vector_similarity(vector: str, target: str) -> Column:
    """Cosine of two array columns in double precision; 0 if either is a zero vector."""
    x = F.transform(vector, lambda v: v.cast("double"))
    t = F.transform(target, lambda v: v.cast("double"))

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    return F.coalesce(
        F.try_divide(dot(x, t), F.sqrt(dot(x, x)) * F.sqrt(dot(t, t))), F.lit(0.0)
    )


def with_target(df: DataFrame, target: DataFrame, cols: Sequence[str], prefix: str) -> DataFrame:
    """Put the single target record beside every row under prefixed names."""
    one = single_record(target.select(*[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in cols]))
    return df.join(F.broadcast(one), F.lit(True))  # exactly one row


def distance_features(similarities: DataFrame, groups: Sequence[str]) -> DataFrame:
    """All similarities of a dataset in descending order -> groups, rank (0-based), similarity.

    Expects groups, record_id, similarity; equal similarities are ranked by id.
    """
    band = F.floor((F.lit(1.0) - F.col("similarity")) * F.lit(2048.0))
    ranked = value_rank(similarities, list(groups), "similarity", band, ID, "rank")
    return ranked.select(*groups, "rank", "similarity")


def closest_rows(similarities: DataFrame, groups: Sequence[str], x: int = 50) -> DataFrame:
    """The x most similar rows of every dataset with all their columns -> ..., rank (0-based)."""
    order = Window.partitionBy(*groups).orderBy(F.desc("similarity"), ID)
    ranked = similarities.withColumn("__place", F.row_number().over(order))
    return (
        ranked.filter(F.col("__place") <= x)
        .withColumn("rank", (F.col("__place") - 1).cast("bigint"))
        .drop("__place")
    )
