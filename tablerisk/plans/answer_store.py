"""Answers of a count interface on many datasets, asked once and stored for good."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerisk.functions.durable import broadcast_if_small, checkpoint_folder, durable
from tablerisk.operators.counts import (
    _reduced,
    apply_mechanism,
    column_states,
    comparable,
    match_queries,
    overlay_counts,
    query_masks,
)
from tablerisk.operators.overlay import Overlay
from tablerisk.operators.prep import single_record
from tablerisk.sources.batches import BatchTable
from tablerisk.spec import ID, Mechanism

BUDGET_UNITS = 1_000_000
MAX_WIDTH = 39


def query_number(query: Sequence[int]) -> int:
    """Stable id of a condition vector over {-1, 0, 1}: its base-3 number."""
    if len(query) > MAX_WIDTH:
        raise ValueError(f"a query has at most {MAX_WIDTH} columns")
    number = 0
    for code in query:
        number = number * 3 + code + 1
    return number


def formatted(solution: Sequence[tuple], mechanism: Mechanism) -> list[tuple[tuple, int]]:
    """A solution as (query, variant): the budget share, the occurrence number, or 0.

    Noisy systems answer each repetition anew; the private one answers once with the summed
    budget; deterministic ones repeat themselves.
    """
    if mechanism.kind == "dp-laplace":
        counts = Counter(solution)
        return [(q, round(n * BUDGET_UNITS / len(solution))) for q, n in counts.items()]
    if mechanism.deterministic:
        return [(q, 0) for q in solution]
    seen: Counter = Counter()
    out = []
    for q in solution:
        out.append((q, seen[q]))
        seen[q] += 1
    return out


def members_table(spark, solutions: Sequence[Sequence[tuple[tuple, int]]]) -> DataFrame:
    """solution_id, pos, query_id, variant."""
    rows = [
        (s, pos, query_number(q), variant)
        for s, solution in enumerate(solutions)
        for pos, (q, variant) in enumerate(solution)
    ]
    return spark.createDataFrame(rows, "solution_id bigint, pos bigint, query_id bigint, variant bigint")


def dataset_labels(tables: DataFrame | Overlay, target_id: int) -> DataFrame:
    """phase, dataset_id and the target's sensitive value."""
    if isinstance(tables, Overlay):
        tables = tables.deltas.filter("weight = 1")
    return tables.filter(F.col(ID) == F.lit(target_id)).select(
        "dataset_id", "phase", F.col("sensitive").cast("int").alias("label")
    )


class AnswerStore:
    """Answers of every asked query on every dataset; a query is put to the interface once, also after a restart.

    A row holds one query's answers on all datasets, in the order of their ids. Rows lie in the batch in which they were
    asked; what is new is found by an anti join with the stored (query, variant) columns, and a reader opens the batches
    that hold its queries only. Datasets that differ from one table in a few rows are given as an overlay. The datasets are reduced to counted states against the target's own values (1 for the sensitive
    column) when the first new query comes: a store that knows all answers computes nothing.
    """

    def __init__(
        self,
        tables: DataFrame | Overlay,
        columns: Sequence[str],
        target: DataFrame,
        mechanism: Mechanism,
        seed: int,
        folder: str | None = None,
    ):
        self.tables, self.columns, self.target = tables, list(columns), target
        self.mechanism, self.seed = mechanism, seed
        self.spark = (tables.base if isinstance(tables, Overlay) else tables).sparkSession
        folder = folder or f"{checkpoint_folder(self.spark).rstrip('/')}/answers-{uuid.uuid4()}"
        self.table = BatchTable(
            self.spark, folder, "query_id bigint, variant bigint, datasets array<bigint>, answers array<bigint>"
        )

    @cached_property
    def states(self) -> DataFrame:
        """Counted states of every dataset, or of what it adds to the base."""
        overlay = isinstance(self.tables, Overlay)
        return durable(self._states(self.tables.deltas if overlay else self.tables, ["dataset_id"]))

    @cached_property
    def base_states(self) -> DataFrame:
        return durable(self._states(self.tables.base, []))

    def _states(self, df: DataFrame, keys: list[str]) -> DataFrame:
        columns = self.columns
        reduced = _reduced(df, columns, keys, True)
        literals = [comparable(c, True).alias(f"__t{i}") for i, c in enumerate(columns[:-1])]
        one = single_record(self.target.select(*literals, F.lit(1).cast("bigint").alias(f"__t{len(columns) - 1}")))
        beside = reduced.join(F.broadcast(one), F.lit(True))  # exactly one row
        return column_states(beside, columns, [f"__t{i}" for i in range(len(columns))], keys)

    def _counts(self, masks: DataFrame) -> DataFrame:
        frames = self.states.select("dataset_id").distinct()
        if isinstance(self.tables, Overlay):
            return overlay_counts(self.base_states, self.states, masks, frames)
        return match_queries(self.states, masks, frames, ["dataset_id"])

    @property
    def asked(self) -> int:
        """How many queries were put to each dataset's interface so far."""
        return sum(note["asked"] for note in self.table.notes.values())

    def update(self, wanted: Iterable[tuple[tuple, int]]) -> int:
        """Answer the queries that are not stored yet; returns how many were new."""
        rows = [(query_number(q), list(q), variant) for q, variant in set(wanted)]
        batch = self.spark.createDataFrame(rows, "query_id bigint, conditions array<int>, variant bigint")
        keys = ["query_id", "variant"]
        new = durable(batch.join(self.table.read().select(*keys), keys, "left_anti"))
        count = new.count()
        if not count:
            return 0
        masks = query_masks(new.dropDuplicates(["query_id"]), len(self.columns))
        exact = self._counts(masks)
        variants = broadcast_if_small(new.select(*keys))
        exact = exact.join(variants, "query_id").withColumn("budget", F.col("variant") / F.lit(float(BUDGET_UNITS)))
        fresh = apply_mechanism(exact, self.mechanism, self.seed, ["dataset_id", *keys])
        entries = F.array_sort(F.collect_list(F.struct("dataset_id", "answer"))).alias("entries")
        packed = fresh.groupBy(*keys).agg(entries)  # one entry a dataset
        packed = packed.select(*keys, F.col("entries.dataset_id").alias("datasets"), F.col("entries.answer").alias("answers"))
        self.table.append(packed, {"asked": count})
        return count

    def rows(self, members: DataFrame | None = None) -> DataFrame:
        """query_id, variant, datasets, answers: of all queries, or of the batches that hold these members."""
        if members is None:
            return self.table.read().drop("batch")
        keys = ["query_id", "variant"]
        wanted = broadcast_if_small(members.select(*keys).distinct())
        held = self.table.read().select(*keys, "batch").join(wanted, keys, "left_semi")
        batches = [r["batch"] for r in held.select("batch").distinct().collect()]  # one number a generation
        return self.table.read(batches).drop("batch").join(wanted, keys, "left_semi")

    def answers(self, members: DataFrame | None = None) -> DataFrame:
        """dataset_id, query_id, variant, answer."""
        both = F.arrays_zip("datasets", "answers")
        long = self.rows(members).select("query_id", "variant", F.explode(both).alias("e"))
        return long.select(F.col("e.datasets").alias("dataset_id"), "query_id", "variant", F.col("e.answers").alias("answer"))


def answer_matrix(members: DataFrame, answers: DataFrame, labels: DataFrame) -> DataFrame:
    """Answers in query order -> solution_id, dataset_id, phase, features, label."""
    joined = answers.join(broadcast_if_small(members), ["query_id", "variant"])
    entry = F.struct("pos", F.col("answer").cast("double").alias("answer"))
    packed = joined.groupBy("solution_id", "dataset_id").agg(
        F.array_sort(F.collect_list(entry)).alias("entries")
    )
    return packed.join(labels, "dataset_id").select(
        "solution_id",
        "dataset_id",
        "phase",
        F.transform("entries", lambda e: e["answer"]).alias("features"),
        "label",
    )
