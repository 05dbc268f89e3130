"""Preparing a private table: selecting, coding, scaling, splitting, removing duplicates."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerisk.functions.durable import BROADCAST_ROWS, durable
from tablerisk.functions.keyed import STREAM_RANK, keyed_hash, mix_int
from tablerisk.functions.ranks import bucketed_rank, kth_smallest
from tablerisk.spec import ID, TableSpec

LOCAL_VALUES = 50_000


def select_columns(df: DataFrame, spec: TableSpec, cols: Sequence[str]) -> DataFrame:
    """Project to ``cols`` (``["all"]`` keeps everything), keeping the record id."""
    return df if cols[0] == "all" else df.select(ID, *spec.select(cols).columns)


def target_record(df: DataFrame, record_id: int) -> DataFrame:
    """The record with this id; empty if there is none."""
    return df.filter(F.col(ID) == F.lit(record_id))


def sample_attributes(spec: TableSpec, n: int, seed: int) -> TableSpec:
    """Keep ``n`` pseudo-randomly chosen attributes in their original order."""
    if not 0 < n <= len(spec.columns):
        raise ValueError(f"n_attributes must be in 1..{len(spec.columns)}")
    ranked = sorted(
        range(len(spec.columns)), key=lambda i: (mix_int(mix_int(seed + 1) + i + 1), i)
    )
    kept = sorted(ranked[:n])
    return spec.select([spec.columns[i] for i in kept])


def value_codes(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, dict[str, int]]:
    """Ordinal codes of every column -> (column, value, code), and the number of codes per column.

    One shuffle finds the distinct values of all columns together; map-side combining keeps a
    frequent value from travelling more than once per task. Values are ordered by Spark's sort in the
    column's own type: missing first, integers as integers, other numbers as numbers with NaN
    last, all else as text. Few values travel through the driver in that order, many stay stored.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"))
            for c in cols
        ]
    )
    types = {f.name: f.dataType for f in df.schema.fields}
    whole = [c for c in cols if isinstance(types[c], T.IntegralType)]
    exact = [c for c in cols if isinstance(types[c], T.DecimalType)]
    real = [c for c in cols if isinstance(types[c], T.FractionalType) and c not in exact]
    distinct = df.select(F.explode(pairs).alias("p")).select("p.column", "p.value").distinct()
    text = F.col("value")
    # the widest scale of the decimal columns, so that none of them is rounded
    scale = max([types[c].scale for c in exact], default=0)
    distinct = distinct.select(
        "column",
        "value",
        F.when(F.col("column").isin(*whole), text.try_cast("bigint")).alias("whole"),
        F.when(F.col("column").isin(*exact), text.try_cast(f"decimal(38,{scale})")).alias("exact"),
        F.when(F.col("column").isin(*real), text.try_cast("double")).alias("real"),
    )
    order = ["column", "whole", "exact", "real", "value"]
    few = distinct.orderBy(*order).limit(LOCAL_VALUES + 1).collect()
    if len(few) <= LOCAL_VALUES:
        return _local_codes(df.sparkSession, few)
    placed = durable(distinct.orderBy(*order)).select(
        "column",
        "value",
        F.spark_partition_id().alias("pid"),
        F.monotonically_increasing_id().alias("at"),
    )
    sizes = placed.groupBy("column", "pid").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("first")
    )
    before = Window.partitionBy("column").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    sizes = durable(sizes.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))))
    code = (F.col("offset") + F.col("at") - F.col("first")).cast("int")
    # one row per sorted partition and column
    mapping = placed.join(F.broadcast(sizes.drop("n")), ["column", "pid"])
    totals = sizes.groupBy("column").agg(F.sum("n").alias("n")).collect()
    return mapping.select("column", "value", code.alias("code")), {r["column"]: r["n"] for r in totals}


def _local_codes(spark, rows) -> tuple[DataFrame, dict[str, int]]:
    """Number rows that Spark has sorted already."""
    sizes: dict[str, int] = {}
    codes = []
    for row in rows:
        codes.append(sizes.get(row["column"], 0))
        sizes[row["column"]] = codes[-1] + 1
    table = pa.table(
        {
            "column": pa.array([r["column"] for r in rows], pa.string()),
            "value": pa.array([r["value"] for r in rows], pa.string()),
            "code": pa.array(codes, pa.int32()),
        }
    )
    return spark.createDataFrame(table), sizes


def apply_codes(
    df: DataFrame, cols: Sequence[str], mapping: DataFrame, sizes: dict[str, int]
) -> DataFrame:
    """Replace each column by its code; mappings of known small size are broadcast."""
    out = df
    for c in cols:
        one = mapping.filter(F.col("column") == c).select(
            F.col("value").alias("__value"), F.col("code").alias("__code")
        )
        if sizes.get(c, 0) <= BROADCAST_ROWS:
            one = F.broadcast(one)
        match = F.col(f"`{c}`").cast("string").eqNullSafe(F.col("__value"))
        out = out.join(one, match, "left").withColumn(c, F.col("__code")).drop("__value", "__code")
    return out.select(*df.columns)


def discretize(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Code ``cols`` by sorted rank -> (coded table, mapping column/value/code)."""
    mapping, sizes = value_codes(df, cols)
    return apply_codes(df, cols, mapping, sizes), mapping


def minmax_normalize(df: DataFrame, cols: Sequence[str], ref_df: DataFrame) -> DataFrame:
    """Scale ``cols`` to the extremes seen in ``ref_df``; a constant column becomes null."""
    if not cols:
        return df
    extremes = ref_df.agg(
        *[F.min(f"`{c}`").alias(f"__lo{i}") for i, c in enumerate(cols)],
        *[F.max(f"`{c}`").alias(f"__hi{i}") for i, c in enumerate(cols)],
    )
    position = {c: i for i, c in enumerate(cols)}

    def scaled(c: str) -> Column:
        low, high = F.col(f"__lo{position[c]}"), F.col(f"__hi{position[c]}")
        return F.try_divide(F.col(f"`{c}`") - low, high - low).alias(c)

    joined = df.join(F.broadcast(extremes), F.lit(True))  # exactly one row
    return joined.select(*[scaled(c) if c in position else F.col(f"`{c}`") for c in df.columns])


def prepare_table(
    df: DataFrame,
    spec: TableSpec,
    cols: Sequence[str] = ("all",),
    n_attributes: int | None = None,
    seed: int = 0,
) -> tuple[DataFrame, TableSpec]:
    """Code, scale by the table's own extremes, then select -> (table, coded spec)."""
    mapping, sizes = value_codes(df, list(spec.categorical))
    coded = apply_codes(df, list(spec.categorical), mapping, sizes)
    scaled = minmax_normalize(coded, list(spec.scaled), df)
    spec = TableSpec(
        spec.categorical,
        spec.continuous,
        spec.scaled,
        {c: tuple(range(sizes.get(c, 0))) for c in spec.categorical},
        spec.columns,
    ).select(cols)
    if n_attributes is not None:
        spec = sample_attributes(spec, n_attributes, seed)
    return scaled.select(ID, *spec.columns), spec


def one_hot(df: DataFrame, spec: TableSpec) -> DataFrame:
    """record_id, continuous columns, then one 0/1 column ``col_category`` per domain entry.

    A category outside the declared domain raises when the row is evaluated.
    """
    out = [F.col(ID)] + [F.col(f"`{c}`") for c in spec.continuous]
    for c in spec.categorical:
        values = [str(v) for v in spec.domain[c]]
        text = F.col(f"`{c}`").cast("string")
        message = F.concat(F.lit(f"unseen category in {c}: "), F.coalesce(text, F.lit("null")))
        known = F.when(text.isin(*values), text).otherwise(F.raise_error(message).cast("string"))
        out += [(known == v).cast("int").alias(f"{c}_{v}") for v in values]
    return df.select(*out)


def split_table(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Add ``split``: aux and target by the id table, eval = every record outside aux.

    Target records lie in eval as well (unless they overlap aux), so they appear twice.
    """
    flags = ids.groupBy(ID).agg(
        F.max(F.col("split") == "aux").alias("__aux"), F.max(F.col("split") == "target").alias("__target")
    )
    aux, target = (F.coalesce(c, F.lit(False)) for c in ("__aux", "__target"))
    roles = F.array(
        F.when(aux, "aux"), F.when(target, "target"), F.when(~aux, "eval")
    )
    joined = df.join(flags, ID, "left")
    return joined.withColumn("split", F.explode(F.array_compact(roles))).select(*df.columns, "split")


def random_split(
    df: DataFrame, test_size: int | None = None, aux_size: int | None = None, seed: int = 0
) -> DataFrame:
    """Add ``split`` in {test, aux}: exact sizes, without replacement; an omitted size is the rest.

    Ids are ranked by hash in buckets and joined back, so the wide rows are not sorted. Rows left
    over are dropped only when both sizes are given, which is what the two sizes ask for.
    """
    if test_size is None and aux_size is None:
        raise ValueError("give test_size or aux_size")
    total = df.count()
    test_size = total - aux_size if test_size is None else test_size
    aux_size = total - test_size if aux_size is None else aux_size
    if min(test_size, aux_size) < 0 or test_size + aux_size > total:
        raise ValueError(f"sizes {test_size} + {aux_size} exceed {total} rows")
    hashed = df.select(ID, keyed_hash(seed, ID, STREAM_RANK).alias("__h"))
    ranked = ranked_by_hash(hashed, total)
    split = F.when(F.col("__rank") < test_size, "test").when(
        F.col("__rank") < test_size + aux_size, "aux"
    )
    chosen = ranked.select(ID, split.alias("split")).filter("split is not null")
    return df.join(chosen, ID).select(*df.columns, "split")


def ranked_by_hash(hashed: DataFrame, total: int, rows_per_bucket: int = 100_000) -> DataFrame:
    """Global 0-based rank by (``__h``, record id), sorted in buckets of the hash's top bits."""
    bits = min(max((max(total, 1) // rows_per_bucket).bit_length(), 3), 16)
    bucket = F.shiftright("__h", 32 - bits)
    return bucketed_rank(hashed, [], bucket, [F.col("__h"), F.col(ID)], "__rank")


def exclude_identical(df: DataFrame, target: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Records that differ from every target in at least one of ``cols``."""
    listed = target.select(*[F.col(f"`{c}`").alias(f"__t_{c}") for c in cols]).distinct()
    same = F.lit(True)
    for c in cols:
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"`__t_{c}`"))
    return df.join(listed, same, "left_anti")


def single_record(df: DataFrame) -> DataFrame:
    """The frame as one stored row; an error if it holds more than one, no row if it is empty."""
    rows = df.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("one record is expected here, more were given")
    return df.sparkSession.createDataFrame(rows, df.schema)


def halve_pool(df: DataFrame) -> DataFrame:
    """Add ``pool``: the first floor(n/2) records by id are "train", the rest "eval"."""
    middle = df.count() // 2
    cut = kth_smallest(df, ID, middle)
    before = F.lit(False) if cut is None else F.col(ID) < F.lit(cut)
    return df.withColumn("pool", F.when(before, "train").otherwise("eval"))


def value_groups(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The rows ``n`` and the smallest record_id of each combination of values in ``cols``."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"), F.min(ID).alias(ID))


def unique_records(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """record_id of the rows whose values in ``cols`` occur exactly once."""
    return value_groups(df, cols).filter("n = 1").select(ID)
