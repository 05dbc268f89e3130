"""Drawing many datasets from one pool without replacement."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerisk.functions.keyed import (
    MASK32,
    MIX_FACTOR,
    STREAM_BIT,
    STREAM_DRAW_HIGH,
    STREAM_DRAW_LOW,
    STREAM_INDEX,
    TWO53,
    keyed_hash,
    with_hashes,
)
from tablerisk.operators.prep import ranked_by_hash
from tablerisk.spec import ID

# Rounds of the keyed permutation, and positions that one row is expanded to.
ROUNDS = 20
CHUNK = 100_000


def dataset_ids(spark: SparkSession, n_datasets: int) -> DataFrame:
    """dataset_id 0..n_datasets-1."""
    return spark.range(n_datasets).withColumnRenamed("id", "dataset_id")


def sample_per_dataset(
    pool: DataFrame,
    datasets: DataFrame,
    n: int | str,
    seed: int,
    n_max: int | None = None,
    pool_size: int | None = None,
) -> DataFrame:
    """For every row of ``datasets`` draw ``n`` distinct pool records -> dataset columns + pool.

    ``n`` is a number or the name of a column of ``datasets`` (then ``n_max`` bounds it). The pool's
    ids get dense positions once; a dataset's k-th record is at the image of k under its own keyed
    permutation of the positions. Work grows with the drawn rows, not with pool x datasets, and a
    smaller sample with the same seed is a part of a larger one.
    """
    wanted = F.col(n) if isinstance(n, str) else F.lit(n)
    n_max = n if n_max is None else n_max
    total = pool.count() if pool_size is None else pool_size
    if n_max > total:
        raise ValueError(f"cannot draw {n_max} of {total} records without replacement")
    hashed = pool.select(ID, keyed_hash(seed, ID, STREAM_INDEX).alias("__h"))
    indexed = ranked_by_hash(hashed, total).select(ID, F.col("__rank").alias("__pos"))
    draws = draw_positions(datasets, wanted, total, seed)
    # only ids are sorted and shuffled; the wide rows meet the (few) drawn ids at the end
    drawn = draws.join(indexed, "__pos").drop("__pos")
    return drawn.join(pool, ID).select(*datasets.columns, *pool.columns)


def draw_positions(datasets: DataFrame, wanted: Column, total: int, seed: int) -> DataFrame:
    """The first ``wanted`` of 0..total-1 in each dataset's order -> dataset columns, __pos.

    A swap-or-not permutation: each round pairs x with (k - x) mod total for a drawn k, and a keyed
    bit of the pair decides whether its two members change places.
    """
    streams = {f"__high{r}": STREAM_DRAW_HIGH + 1000 * r for r in range(ROUNDS)}
    streams |= {f"__low{r}": STREAM_DRAW_LOW + 1000 * r for r in range(ROUNDS)}
    keyed = with_hashes(datasets.withColumn("__wanted", wanted.cast("bigint")), seed, ["dataset_id"], streams)
    keyed = keyed.filter("__wanted > 0")
    last = F.floor((F.col("__wanted") - 1) / F.lit(CHUNK)).cast("bigint")
    parts = keyed.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    first = F.col("__part") * F.lit(CHUNK)
    end = F.least(first + F.lit(CHUNK), F.col("__wanted")) - 1
    highs, lows = (F.array(*[f"__{k}{r}" for r in range(ROUNDS)]) for k in ("high", "low"))
    rows = parts.select(
        *datasets.columns, first.alias("__first"), end.alias("__end"), highs.alias("__high"), lows.alias("__low")
    )
    # the few rows of datasets become many: spread them before they are expanded
    rows = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)
    schema = T.StructType([*datasets.schema.fields, T.StructField("__pos", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                one = batch.slice(i, 1)
                begin, stop, high, low = (one.column(c)[0].as_py() for c in ("__first", "__end", "__high", "__low"))
                x = permuted(np.arange(begin, stop + 1), high, low, total)
                columns = [one.column(c).take(pa.array(np.zeros(len(x), np.int64))) for c in datasets_columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(x)], [*datasets_columns, "__pos"])

    datasets_columns = datasets.columns
    return rows.mapInArrow(run, schema)


def permuted(x: np.ndarray, high: list[int], low: list[int], total: int) -> np.ndarray:
    """Positions after all rounds; ``high`` and ``low`` are the rounds' hashes."""
    for a, b in zip(high, low):
        key = int(np.floor(np.float64((a << 21) + (b >> 11)) / TWO53 * np.float64(total)))
        pair = (key - x + total) % total
        top = np.maximum(x, pair).astype(np.uint64)
        bit = ((top & np.uint64(MASK32)) ^ (top >> np.uint64(32))) + np.uint64(b + 1) & np.uint64(MASK32)
        for _ in range(2):
            bit = ((bit >> np.uint64(16)) ^ bit) * np.uint64(MIX_FACTOR) & np.uint64(MASK32)
        bit = (bit >> np.uint64(16)) ^ bit
        x = np.where(bit & np.uint64(1) == 1, pair, x)
    return x


def sensitive_bit(df: DataFrame, seed: int, name: str = "sensitive") -> DataFrame:
    """Add a fair random bit per (dataset, record)."""
    hashed = with_hashes(df, seed, ["dataset_id", ID], {"__h": STREAM_BIT})
    return hashed.withColumn(name, F.col("__h").bitwiseAND(F.lit(1)).cast("int")).drop("__h")


def dataset_numbers(n_datasets: int) -> Column:
    """0..n_datasets-1, to be exploded beside every row."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_datasets - 1).cast("bigint")))


def randomize_sensitive(df: DataFrame, n_datasets: int, seed: int) -> DataFrame:
    """Copies of the table, each with its own random binary sensitive column."""
    copies = df.withColumn("dataset_id", dataset_numbers(n_datasets))
    return sensitive_bit(copies, seed).select("dataset_id", *df.columns, "sensitive")


def exact_shadow(df: DataFrame, n_datasets: int, seed: int, target_id: int) -> DataFrame:
    """Copies of a table with a ``sensitive`` column where only the target's value is redrawn."""
    copies = df.withColumnRenamed("sensitive", "__kept").withColumn(
        "dataset_id", dataset_numbers(n_datasets)
    )
    drawn = sensitive_bit(copies, seed, "__bit")
    value = F.when(F.col(ID) == F.lit(target_id), F.col("__bit")).otherwise(F.col("__kept"))
    return drawn.withColumn("sensitive", value.cast("int")).select("dataset_id", *df.columns)
