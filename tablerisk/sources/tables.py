"""Reading private tables and their metadata, and ingesting raw files as integer matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablerisk.operators.prep import discretize
from tablerisk.spec import ID, TableSpec


def read_metadata(spark: SparkSession, path: str) -> TableSpec:
    """Read a JSON list of {name, type, representation} into a TableSpec."""
    schema = "name string, type string, representation array<string>"
    rows = spark.read.schema(schema).json(path, multiLine=True).collect()  # one row per column
    categorical = [r.name for r in rows if r.type == "finite"]
    continuous = [r.name for r in rows if r.type in ("Integer", "Float")]
    return TableSpec(
        categorical=tuple(categorical),
        continuous=tuple(continuous),
        scaled=tuple(r.name for r in rows if r.type == "Float"),
        domain={r.name: tuple(r.representation or ()) for r in rows if r.type == "finite"},
        order=tuple(r.name for r in rows if r.name in {*categorical, *continuous}),
    )


def with_row_number(df: DataFrame, name: str = ID) -> DataFrame:
    """Number the rows 0.. in file order without moving them.

    Each partition counts its rows; the (small) table of partition sizes gives the offsets. Store
    the result if the id has to outlive the session.
    """
    tagged = df.withColumn("__pid", F.spark_partition_id()).withColumn(
        "__local", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    )
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy("__pid")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    )
    # one row per partition of the scan, so the broadcast side cannot grow with the rows
    return tagged.join(F.broadcast(offsets), "__pid").select(
        (F.col("__offset") + F.col("__local")).alias(name), *df.columns
    )


def load_table(
    spark: SparkSession,
    path: str | Sequence[str],
    spec: TableSpec,
    id_column: str | None = None,
    drop: Sequence[str] = ("Person ID",),
    fmt: str = "parquet",
) -> DataFrame:
    """Read a table, drop identifier columns, cast attributes to their declared types.

    Categorical columns become strings with missing values as the category ``"nan"``, continuous
    ones doubles. ``id_column`` becomes ``record_id``; without one, rows are numbered in file order.
    """
    reader = spark.read
    if fmt == "csv":
        df = reader.csv(path, header=True)
    elif isinstance(path, str):
        df = reader.format(fmt).load(path)
    else:
        df = reader.format(fmt).load(list(path))
    df = df.drop(*[c for c in drop if c in df.columns and c != id_column])
    attributes = [
        F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan")).alias(c)
        if c in spec.categorical
        else F.col(f"`{c}`").cast("double").alias(c)
        for c in spec.columns
    ]
    if id_column is not None:
        return df.select(F.col(id_column).cast("bigint").alias(ID), *attributes)
    return with_row_number(df.select(*attributes))


def read_raw(
    spark: SparkSession,
    paths: Sequence[str],
    columns: Sequence[str] | None,
    drop: Sequence[str] = (),
    fmt: str = "csv",
    sep: str = ",",
) -> DataFrame:
    """Append raw files (header-less CSV/TSV, plain or gzip, or any Spark format) by name."""
    parts = []
    for path in paths:
        if fmt == "csv":
            schema = ", ".join(f"`{c}` string" for c in columns)
            parts.append(
                spark.read.csv(path, schema=schema, sep=sep, ignoreLeadingWhiteSpace=True)
            )
        else:
            part = spark.read.format(fmt).load(path)
            parts.append(part.select(*columns) if columns else part)
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part)
    return df.drop(*drop)


def ingest_discretized(
    df: DataFrame, id_column: str | None = None, sink: str | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Turn a raw table (see ``read_raw``) into an integer matrix, optionally written to ``sink``."""
    if id_column is None:
        df = with_row_number(df)
        id_column = ID
    attributes = [c for c in df.columns if c != id_column]
    coded, _ = discretize(df, attributes)
    coded = coded.withColumnRenamed(id_column, ID)
    if sink is not None:
        coded.write.mode("overwrite").option("header", True).format(fmt).save(sink)
    return coded
