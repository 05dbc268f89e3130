"""Exact ranks and quantiles that stay distributed when one group holds most of the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed_rank(
    df: DataFrame, groups: list[str], bucket: Column, order: list[Column], name: str
) -> DataFrame:
    """Add the exact 0-based rank inside each group.

    ``bucket`` must be monotone in ``order``. Rows are numbered inside (group, bucket) and shifted
    by the number of rows in lower buckets, so no task ever sorts a whole group. The final join
    has the window's own partitioning and adds no shuffle of the rows. Groups are never null.
    """
    tagged = df.withColumn("__rank_bucket", bucket)
    keys = [*groups, "__rank_bucket"]
    below = Window.orderBy("__rank_bucket").rowsBetween(Window.unboundedPreceding, -1)
    if groups:
        below = below.partitionBy(*groups)
    offsets = (
        tagged.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__rank_rows"))
        .select(*keys, F.coalesce(F.sum("__rank_rows").over(below), F.lit(0)).alias("__rank_offset"))
    )
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    numbered = tagged.withColumn("__rank_inside", inside)
    return numbered.join(offsets, keys).select(
        *df.columns, (F.col("__rank_offset") + F.col("__rank_inside")).alias(name)
    )


def value_rank(
    df: DataFrame, groups: list[str], value: str, band: Column, tie: str, name: str
) -> DataFrame:
    """Exact 0-based rank per group by ``value`` descending, then by the integer ``tie``.

    ``band`` grows as ``value`` falls. Ranks start from counts of distinct values, and equal values
    are numbered in stretches of 65536 ties, so neither a large group nor a large set of copies
    is sorted by one task.
    """
    keys = [*groups, value]
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).withColumn("__band", band)
    inside = Window.partitionBy(*groups, "__band").orderBy(F.desc(value))
    lower = Window.partitionBy(*groups).orderBy("__band")
    before = (Window.unboundedPreceding, -1)
    bands = counted.groupBy(*groups, "__band").agg(F.sum("__n").alias("__m")).select(
        *groups, "__band", F.coalesce(F.sum("__m").over(lower.rowsBetween(*before)), F.lit(0)).alias("__skip")
    )
    starts = (
        counted.withColumn("__in", F.coalesce(F.sum("__n").over(inside.rowsBetween(*before)), F.lit(0)))
        .join(bands, [*groups, "__band"])
        .select(*keys, (F.col("__skip") + F.col("__in")).alias("__start"))
    )
    tied = bucketed_rank(df, keys, F.shiftright(tie, 16), [F.col(tie)], "__tie")
    return tied.join(starts, keys).select(
        *df.columns, (F.col("__start") + F.col("__tie")).alias(name)
    )


SORTED_AT_ONCE = 100_000
ZONE_BANDS = 1024


def kth_smallest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th smallest (from 0) of an integer column, in its own type; None beyond the end.

    An approximate bracket around the rank is counted exactly and narrowed until few values are left.
    """
    rows = df.select(F.col(column).cast("bigint").alias("v")).filter("v is not null")
    skipped, size = 0, rows.count()
    if k >= size:
        return None
    while size > SORTED_AT_ONCE:
        share = (k - skipped) / size
        q = [max(share - 0.01, 0.0), min(share + 0.01, 1.0)]
        # distances from the smallest value, as approximate quantiles are doubles inside
        base = rows.agg(F.min("v")).first()[0]
        distance = (F.col("v").cast("decimal(20,0)") - F.lit(base)).cast("double")
        found = rows.agg(F.percentile_approx(distance, q, 10000)).first()[0]
        low, high = base + math.floor(found[0]), base + math.ceil(found[1])
        low, high = max(low, -(2**63)), min(high, 2**63 - 1)
        below, inside = rows.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v").between(low, high))).first()
        if k - skipped < below:
            rows, now = rows.filter(F.col("v") < low), below
        elif k - skipped < below + inside:
            rows, now, skipped = rows.filter(F.col("v").between(low, high)), inside, skipped + below
            if low == high:
                return low
        else:
            rows, now, skipped = rows.filter(F.col("v") > high), size - below - inside, skipped + below + inside
        if now == size:
            break
        size = now
    return rows.orderBy("v").offset(k - skipped).first()[0]


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join on ``keys`` where null equals null; keeps the left copy of the keys."""
    renamed = right
    condition = F.lit(True)
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"__r_{key}")
        matched = F.col(key).eqNullSafe(F.col(f"__r_{key}"))
        condition = matched if key == keys[0] else condition & matched
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"__r_{key}" for key in keys])


def grouped_quantile(
    df: DataFrame, groups: list[str], value: str, q: float, name: str, margin: float = 0.001
) -> DataFrame:
    """Exact linear-interpolated quantile of ``value`` per group -> groups, ``name``.

    An approximate bracket around the wanted rank splits each group into below / inside / above.
    Only the zones that really hold the two neighbouring ranks are looked at, as distinct values
    with counts; if the bracket misses, the zone beside it is used, so the answer is always exact. No task holds a whole
    zone: its values are ranked in bands.
    """
    rows = df.select(*groups, F.col(value).cast("double").alias("__v")).filter("__v is not null")
    bracket = rows.groupBy(*groups).agg(
        F.percentile_approx("__v", [max(q - margin, 0.0), min(q + margin, 1.0)], 10000).alias("__b")
    )
    zone = (
        F.when(F.col("__v") < F.col("__b")[0], 0)
        .when(F.col("__v") <= F.col("__b")[1], 1)
        .otherwise(2)
    )
    if groups:
        zoned = null_safe_join(rows, bracket, groups, "inner")
    else:
        zoned = rows.join(F.broadcast(bracket), F.lit(True))  # exactly one row
    zoned = zoned.select(*groups, "__v", zone.alias("__zone"))
    sizes = zoned.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("__n"),
        F.count(F.when(F.col("__zone") == 0, 1)).alias("__n0"),
        F.count(F.when(F.col("__zone") <= 1, 1)).alias("__n1"),
        F.array(*[F.min(F.when(F.col("__zone") == z, F.col("__v"))) for z in range(3)]).alias("__mins"),
        F.array(*[F.max(F.when(F.col("__zone") == z, F.col("__v"))) for z in range(3)]).alias("__maxs"),
    )
    exact_rank = F.lit(q) * (F.col("__n") - 1)
    low, high = F.floor(exact_rank), F.ceil(exact_rank)

    def zone_of(rank: Column) -> Column:
        return F.when(rank < F.col("__n0"), 0).when(rank < F.col("__n1"), 1).otherwise(2)

    wanted = sizes.select(
        *groups,
        low.alias("__low"),
        high.alias("__high"),
        (exact_rank - low).alias("__frac"),
        zone_of(low).alias("__zlow"),
        zone_of(high).alias("__zhigh"),
        F.array(F.lit(0).cast("bigint"), F.col("__n0"), F.col("__n1")).alias("__starts"),
        "__mins",
        "__maxs",
    )
    counted = zoned.groupBy(*groups, "__zone", "__v").agg(F.count(F.lit(1)).alias("__c"))
    if groups:
        joined = null_safe_join(counted, wanted, groups, "inner")
    else:
        joined = counted.join(F.broadcast(wanted), F.lit(True))  # exactly one row
    picked = joined.filter(F.col("__zone").isin(0, 1, 2)).filter(
        (F.col("__zone") == F.col("__zlow")) | (F.col("__zone") == F.col("__zhigh"))
    )
    # a zone's values are numbered in bands of its range, with the counts of lower bands as offsets
    least, most = (F.element_at(c, F.col("__zone") + 1) for c in ("__mins", "__maxs"))
    share = F.try_divide(F.col("__v") - least, most - least)
    band = F.floor(F.coalesce(F.nanvl(share, F.lit(0.0)), F.lit(0.0)) * ZONE_BANDS)
    picked = picked.withColumn("__band", band)
    zones = [*groups, "__zone"]
    lower = Window.partitionBy(*zones).orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)
    bands = picked.groupBy(*zones, "__band").agg(F.sum("__c").alias("__m"))
    bands = bands.withColumn("__before", F.coalesce(F.sum("__m").over(lower), F.lit(0))).drop("__m")
    running = Window.partitionBy(*zones, "__band").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    counted_in = picked.withColumn("__in", F.sum("__c").over(running))
    counted_in = null_safe_join(counted_in, bands, [*zones, "__band"], "inner")
    ranked = counted_in.withColumn(
        "__end", F.element_at("__starts", F.col("__zone") + 1) + F.col("__before") + F.col("__in")
    ).withColumn("__start", F.col("__end") - F.col("__c"))

    def at(rank: str) -> Column:
        hit = (F.col(rank) >= F.col("__start")) & (F.col(rank) < F.col("__end"))
        return F.max(F.when(hit, F.col("__v")))

    result = ranked.groupBy(*groups).agg(
        at("__low").alias("__a"), at("__high").alias("__z"), F.max("__frac").alias("__f")
    )
    return result.select(
        *groups, (F.col("__a") + (F.col("__z") - F.col("__a")) * F.col("__f")).alias(name)
    )
