"""Many versions of one table that differ in a few rows, kept as the table and its differences."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerisk.operators.sampling import dataset_numbers, sensitive_bit
from tablerisk.spec import ID


@dataclass(frozen=True)
class Overlay:
    """``base`` is what every dataset holds; ``deltas`` has the rows that a dataset loses (weight -1) or gains (+1).

    deltas: dataset_id, the base's columns, weight, and any columns that describe the dataset. Every dataset
    has a delta row, if only a record that it loses and gains again. A changed record costs two rows, not a table.
    """

    base: DataFrame
    deltas: DataFrame

    def tables(self) -> DataFrame:
        """dataset_id and the rows of every dataset, written out."""
        columns = self.base.columns
        datasets = self.deltas.select("dataset_id").distinct()
        copies = datasets.join(self.base.withColumn("__one", F.lit(1)), F.col("__one") == 1).drop("__one")
        whole = copies.withColumn("weight", F.lit(1)).unionByName(self.deltas.select("dataset_id", *columns, "weight"))
        keys = ["dataset_id", *columns]
        return whole.groupBy(*keys).agg(F.sum("weight").alias("n")).select(
            *keys, F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))).alias("__k")
        ).drop("__k")


def exact_overlay(df: DataFrame, n_datasets: int, seed: int, target_id: int) -> Overlay:
    """``exact_shadow`` as differences: a table with a ``sensitive`` column where only the target's value is redrawn."""
    target = df.filter(F.col(ID) == F.lit(target_id)).withColumn("dataset_id", dataset_numbers(n_datasets))
    drawn = sensitive_bit(target, seed, "__bit")
    weights = F.array(*[F.struct(F.lit(w).alias("weight"), v.alias("value")) for w, v in ((-1, F.col("sensitive")), (1, F.col("__bit")))])
    rows = drawn.withColumn("__w", F.explode(weights))
    rows = rows.withColumn("sensitive", F.col("__w.value").cast(df.schema["sensitive"].dataType))
    return Overlay(df, rows.select("dataset_id", *df.columns, F.col("__w.weight").alias("weight")))
