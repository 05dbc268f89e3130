"""Shadow tables: many resampled versions of a table, kept as one long DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablerisk.functions.durable import durable
from tablerisk.functions.keyed import STREAM_RANK, keyed_hash
from tablerisk.functions.ranks import bucketed_rank
from tablerisk.operators.prep import exclude_identical, halve_pool, single_record
from tablerisk.operators.sampling import (
    dataset_ids,
    sample_per_dataset,
    sensitive_bit,
)
from tablerisk.spec import ID


def shadow_tables(
    pool: DataFrame,
    targets: DataFrame,
    n: int,
    n_datasets: int,
    seed: int,
    pool_size: int | None = None,
) -> DataFrame:
    """Training tables of size ``n`` for every target -> target_id, dataset_id, in_dataset, columns.

    Even datasets hold the target and n-1 pool records, odd ones n pool records. ``dataset_id`` is
    unique over targets: it is the dataset's number plus n_datasets times the target's position,
    or times its ``number`` where the targets carry one.
    """
    targets = durable(targets)
    numbered = target_numbers(targets)
    frames = numbered.select(
        F.col(ID).alias("target_id"),
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(n_datasets - 1)),
                lambda i: F.col("number") * n_datasets + i,
            )
        ).alias("dataset_id"),
    )
    frames = frames.withColumn("in_dataset", F.col("dataset_id") % n_datasets % 2 == 0)
    frames = frames.withColumn("__n", F.lit(n) - F.col("in_dataset").cast("int"))
    drawn = sample_per_dataset(pool, frames, "__n", seed, n, pool_size).drop("__n")
    members = frames.filter("in_dataset").drop("__n").join(
        targets.select(*pool.columns).withColumn("target_id", F.col(ID)), "target_id"
    )
    return drawn.unionByName(members)


def target_numbers(targets: DataFrame) -> DataFrame:
    """record_id and number: the given one, or the target's position by id."""
    if "number" in targets.columns:
        return targets.select(ID, "number")
    return bucketed_rank(targets.select(ID), [], F.shiftright(ID, 16), [F.col(ID)], "number")


def _with_record(frames: DataFrame, record: DataFrame) -> DataFrame:
    """Put one record beside every row of ``frames``; the broadcast side is exactly one row."""
    return frames.join(F.broadcast(single_record(record)), F.lit(True))


def shadow_tables_specific(
    target_table: DataFrame,
    targets: DataFrame,
    eval_pool: DataFrame,
    n_datasets: int,
    seed: int,
) -> DataFrame:
    """Evaluation tables of every target: the fixed target table with the target (even) or a random other record.

    -> target_id, dataset_id, in_dataset, columns. The target is taken out of the table and of the reference pool
    first. ``targets`` are the few that are audited together (their ids become literals); dataset_ids are numbered as
    in ``shadow_tables``. Two references are drawn and the one that is not the target is taken, so one pool and one draw serve
    all targets.
    """
    columns = target_table.columns
    targets = durable(targets)
    known = target_numbers(targets).collect()  # the targets of one round
    both = F.array(
        *[F.struct(F.lit(r[ID]).cast("bigint").alias("target_id"), F.lit(r["number"]).cast("bigint").alias("number")) for r in known]
    )
    numbers = F.transform(F.sequence(F.lit(0), F.lit(n_datasets - 1)), lambda i: i.cast("bigint"))

    def frames(rows: DataFrame, *kept: str) -> DataFrame:
        beside = rows.withColumn("__t", F.explode(both)).withColumn("__i", F.explode(numbers))
        return beside.select(
            F.col("__t.target_id").alias("target_id"),
            (F.col("__t.number") * n_datasets + F.col("__i")).alias("dataset_id"),
            (F.col("__i") % 2 == 0).alias("in_dataset"),
            *kept,
        )

    wanted = frames(target_table.sparkSession.range(1))
    base = frames(target_table, *columns).filter(F.col(ID) != F.col("target_id"))
    pool_size = eval_pool.count()
    drawn = sample_per_dataset(eval_pool, wanted.filter("not in_dataset"), min(2, pool_size), seed, pool_size=pool_size)
    drawn = drawn.filter(F.col(ID) != F.col("target_id")).withColumn("__h", keyed_hash(seed, ID, STREAM_RANK))
    place = F.row_number().over(Window.partitionBy("target_id", "dataset_id").orderBy("__h", ID))
    references = drawn.withColumn("__k", place).filter("__k = 1")
    members = wanted.filter("in_dataset").join(
        targets.select(*columns).withColumn("target_id", F.col(ID)), "target_id"
    )
    order = ["target_id", "dataset_id", "in_dataset", *columns]
    return base.select(*order).unionByName(references.select(*order)).unionByName(members.select(*order))


def shadow_tables_average(
    eval_pool: DataFrame, targets: DataFrame, n: int, n_datasets: int, seed: int
) -> DataFrame:
    """Evaluation tables resampled from the eval pool without the targets."""
    others = eval_pool.join(targets.select(ID), ID, "left_anti")
    return shadow_tables(others, targets, n, n_datasets, seed)


def target_dataset(
    pool: DataFrame, target: DataFrame, cols: Sequence[str], n: int, datasets: DataFrame, seed: int
) -> DataFrame:
    """n-1 records that differ from the target, the target, and a random sensitive column."""
    others = durable(exclude_identical(pool, target, cols))
    drawn = sample_per_dataset(others, datasets, n - 1, seed).withColumn("is_target", F.lit(False))
    members = _with_record(datasets, target.select(*pool.columns))
    whole = drawn.unionByName(members.withColumn("is_target", F.lit(True)).select(*drawn.columns))
    return sensitive_bit(whole, seed).select(
        *datasets.columns, *pool.columns, "sensitive", "is_target"
    )


def auxiliary_shadow(
    pool: DataFrame,
    target: DataFrame,
    cols: Sequence[str],
    n: int,
    n_datasets: int,
    seed: int,
    eval_share: float = 0.5,
) -> DataFrame:
    """Attribute-audit shadow datasets from two disjoint half pools -> phase, dataset_id, ...

    The first floor(n_datasets * (1 - eval_share)) datasets are drawn from the train half, the
    others from the eval half.
    """
    # stored once: counting, halving, indexing and drawing all read it
    others = durable(exclude_identical(pool, target, cols))
    total = others.count()
    sizes = {"train": total // 2, "eval": total - total // 2}
    others = halve_pool(others)
    n_train = int(n_datasets * (1 - eval_share))
    frames = dataset_ids(pool.sparkSession, n_datasets).withColumn(
        "phase", F.when(F.col("dataset_id") < n_train, "train").otherwise("eval")
    )
    halves = []
    for phase in ("train", "eval"):
        half = others.filter(F.col("pool") == phase).drop("pool")
        wanted = frames.filter(F.col("phase") == phase)
        halves.append(sample_per_dataset(half, wanted, n - 1, seed, pool_size=sizes[phase]))
    drawn = halves[0].unionByName(halves[1]).withColumn("is_target", F.lit(False))
    members = _with_record(frames, target.select(*pool.columns))
    whole = drawn.unionByName(members.withColumn("is_target", F.lit(True)).select(*drawn.columns))
    return sensitive_bit(whole, seed).select(
        "phase", "dataset_id", *pool.columns, "sensitive", "is_target"
    )


def shadow_summary(tables: DataFrame, target_id: int, bins: int = 10) -> DataFrame:
    """Per dataset: size, the bin of the target's position by id, and the target's sensitive bit."""
    here = F.col(ID) == F.lit(target_id)
    position = F.count(F.when(F.col(ID) < F.lit(target_id), 1))
    return tables.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.least(
            F.floor(position * F.lit(bins) / F.count(F.lit(1))), F.lit(bins - 1)
        ).cast("int").alias("target_position_bin"),
        F.max(F.when(here, F.col("sensitive"))).alias("label"),
    )
