"""Generating count queries and analysing sets of them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablerisk.functions.keyed import STREAM_QUERY, with_hashes
from tablerisk.functions.ranks import bucketed_rank
from tablerisk.spec import TableSpec


def query_name(conditions: Column, columns: Sequence[str]) -> Column:
    """``condition_column`` of every set condition, joined by underscores."""
    parts = [
        F.when(
            F.element_at(conditions, i + 1) != 0,
            F.concat_ws("_", F.element_at(conditions, i + 1).cast("string"), F.lit(c)),
        )
        for i, c in enumerate(columns)
    ]
    return F.concat_ws("_", *parts)


def lattice_size(spec: TableSpec, orders: Sequence[int], n_cat: int, n_cont: int) -> int:
    """Number of condition vectors of the given orders."""
    cats, conts = len(spec.categorical), len(spec.continuous)
    total = 0
    for order in set(orders):
        for from_cat in range(max(0, order - conts), min(order, cats) + 1):
            choices = math.comb(cats, from_cat) * math.comb(conts, order - from_cat)
            total += choices * n_cat**from_cat * n_cont ** (order - from_cat)
    return total


def query_lattice(
    spark: SparkSession,
    spec: TableSpec,
    orders: Sequence[int],
    cat_options: Sequence[int] = (1,),
    cont_options: Sequence[int] = (3,),
    limit: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """All condition vectors of the given orders -> query_id, conditions, name.

    ``query_id`` is the mixed-radix number of the vector: digit i is 0 for no condition on column
    i, else the option's position + 1. Vectors are built column by column, so no more of them arise on the way
    than there are with at most the highest order's conditions. If ``limit`` is given and exceeded, ``limit`` vectors are sampled.
    """
    columns = spec.columns
    options = [cat_options if c in spec.categorical else cont_options for c in columns]
    weights, total = [], 1
    for choice in options:
        weights.append(total)
        total *= len(choice) + 1
    if total > 1 << 63:
        raise ValueError("query_id has 64 bits: fewer columns or options")
    n_cat, n_cont = len(cat_options), len(cont_options)
    lowest, highest = min(orders, default=0), max(orders, default=-1)
    lattice = spark.range(1).select(F.lit(0).cast("bigint").alias("query_id"), F.lit(0).alias("n"))
    for i, choice in enumerate(options):
        # no more conditions than the highest order, and enough columns left for the lowest
        more = F.sequence(F.lit(0), F.lit(len(choice)))
        lattice = lattice.withColumn("__d", F.explode(F.when(F.col("n") < highest, more).otherwise(F.array(F.lit(0)))))
        lattice = lattice.select(
            (F.col("query_id") + F.col("__d") * F.lit(weights[i]).cast("bigint")).alias("query_id"),
            (F.col("n") + (F.col("__d") > 0).cast("int")).alias("n"),
        ).filter(F.col("n") + (len(columns) - 1 - i) >= lowest)
        if i == len(columns) // 2:
            lattice = lattice.repartition(spark.sparkContext.defaultParallelism)
    lattice = lattice.filter(F.col("n").isin(*orders)).select("query_id")
    digits = [F.expr(f"query_id div {weights[i]}L % {len(choice) + 1}") for i, choice in enumerate(options)]
    codes = [
        F.element_at(F.array(*[F.lit(v) for v in (0, *choice)]), digits[i].cast("int") + 1)
        for i, choice in enumerate(options)
    ]
    if limit is not None and lattice_size(spec, orders, n_cat, n_cont) > limit:
        hashed = with_hashes(lattice, seed, ["query_id"], {"__h": STREAM_QUERY})
        order = [F.col("__h"), F.col("query_id")]
        ranked = bucketed_rank(hashed, [], F.shiftright("__h", 24), order, "__rank")
        lattice = ranked.filter(F.col("__rank") < limit).select("query_id")
    lattice = lattice.select("query_id", F.array(*codes).alias("conditions"))
    return lattice.withColumn("name", query_name(F.col("conditions"), columns))


def condition_text(conditions: Column) -> Column:
    """Readable key of a condition vector."""
    return F.array_join(F.transform(conditions, lambda c: c.cast("string")), ",")


def query_multiplicity(queries: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Distinct queries with their count and number of conditions."""
    n_conditions = F.size(F.filter("conditions", lambda c: c != 0))
    counted = queries.groupBy(*groups, "conditions").agg(F.count(F.lit(1)).alias("multiplicity"))
    return counted.withColumn("n_conditions", n_conditions)


def query_occurrences(queries: DataFrame, order: str, groups: Sequence[str] = ()) -> DataFrame:
    """Number the repetitions of each query 0.. in the order of the integer column ``order``.

    A popular query is numbered in bands of 65536 consecutive ``order`` values, so its repetitions
    are split over tasks.
    """
    keyed = queries.withColumn("__key", condition_text(F.col("conditions")))
    band = F.shiftright(F.col(order).cast("bigint"), 16)
    return bucketed_rank(
        keyed, [*groups, "__key"], band, [F.col(order)], "occurrence"
    ).drop("__key")


def budget_shares(queries: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Each distinct query's share of its solution, used as its privacy-budget fraction."""
    counted = queries.groupBy(*groups, "conditions").agg(F.count(F.lit(1)).alias("n"))
    if groups:
        totals = counted.groupBy(*groups).agg(F.sum("n").alias("total"))
        joined = counted.join(totals, list(groups))
    else:
        totals = counted.agg(F.sum("n").alias("total"))
        joined = counted.join(F.broadcast(totals), F.lit(True))  # exactly one row
    return joined.select(*groups, "conditions", (F.col("n") / F.col("total")).alias("budget"))


def difference_query_pairs(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Query pairs that isolate one user group -> (leading/partner/position, unpaired rest).

    A leading query has a condition on the last (sensitive) column and no -1 elsewhere; its partner
    equals it except for one 0 that became -1. Partners are found by an equi-join on the query text
    with the changed position blanked, not by comparing all pairs.
    """
    distinct = queries.select("conditions").distinct()
    distinct = distinct.withColumn("text", condition_text(F.col("conditions")))
    size = F.size("conditions")
    leads = (F.element_at("conditions", -1) != 0) & ~F.exists(
        F.slice("conditions", 1, size - 1), lambda c: c == -1
    )

    def blanked(value: int) -> DataFrame:
        spots = distinct if value == -1 else distinct.filter(leads)
        at = spots.select(
            "conditions", "text", F.posexplode(F.slice("conditions", 1, size - 1)).alias("p", "c")
        ).filter(F.col("c") == value)
        masked = F.transform(
            "conditions", lambda c, i: F.when(i == F.col("p"), "*").otherwise(c.cast("string"))
        )
        return at.select("text", F.col("p").alias("position"), F.array_join(masked, ",").alias("k"))

    # the blanked text fixes position and all other conditions: one leading, one partner per key
    partners = blanked(-1).select("k", F.col("text").alias("partner"))
    pairs = blanked(0).withColumnRenamed("text", "leading").join(partners, "k")
    pairs = pairs.select("leading", "partner", "position")
    used = pairs.select(F.explode(F.array("leading", "partner")).alias("text")).distinct()
    rest = distinct.join(used, "text", "left_anti").select("conditions", "text")
    return pairs, rest
