"""Result tables: partitioned sinks and resuming unfinished work."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame


def run_key(parameters: dict) -> str:
    """Short stable name of a parameter set, used as a directory name."""
    text = json.dumps(parameters, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def write_results(df: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Write results partitioned by ``keys``, replacing only the partitions present in ``df``.

    Returns the stored table, read back.
    """
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*keys).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def resume_targets(targets: DataFrame, path: str, key: str) -> DataFrame:
    """Targets without a stored result under ``path``; all of them if nothing is stored."""
    spark = targets.sparkSession
    try:
        finished = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return targets
        raise
    return targets.join(finished.select(key).distinct(), key, "left_anti")
