"""Append-only tables of committed batches, for jobs that must survive their driver."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BatchTable:
    """A stored table that grows by whole batches, numbered from 0.

    A batch counts once its marker is written, after its rows; rows without a marker are what a killed job left behind.
    They are never read, and the repeated batch replaces them. The marker carries a small note of the writer.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.schema, self.folder = spark, schema, folder.rstrip("/")
        self.notes = self._stored_notes()

    def _stored_notes(self) -> dict[int, dict]:
        """Notes of the committed batches: one row a batch."""
        try:
            marks = self.spark.read.schema("note string, batch int").parquet(f"{self.folder}/done").collect()
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return {}
            raise
        return {r["batch"]: json.loads(r["note"]) for r in marks}

    @property
    def batches(self) -> list[int]:
        return sorted(self.notes)

    def append(self, df: DataFrame, note: dict | None = None) -> int:
        """Store one more batch, then its marker; returns its number."""
        batch = max(self.notes, default=-1) + 1
        df.write.mode("overwrite").parquet(f"{self.folder}/rows/batch={batch}")
        mark = self.spark.range(1).select(F.lit(json.dumps(note or {})).alias("note"))
        mark.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/done/batch={batch}")
        self.notes[batch] = note or {}
        return batch

    def read(self, batches: Iterable[int] | None = None) -> DataFrame:
        """The committed rows, of all batches or of the given ones only, with their ``batch``."""
        wanted = self.batches if batches is None else sorted(set(batches) & set(self.notes))
        if not wanted:
            return self.spark.createDataFrame([], f"{self.schema}, batch int")
        reader = self.spark.read.schema(f"{self.schema}, batch int").option("basePath", f"{self.folder}/rows")
        return reader.parquet(*[f"{self.folder}/rows/batch={b}" for b in wanted])
