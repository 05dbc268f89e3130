"""Searching for the set of count queries that best reveals a sensitive attribute.

The search itself handles a few hundred small solutions and runs as a plain loop; every generation's answers and fitness
are Spark jobs over all shadow datasets. Each generation is stored with the loop's random state before the next one
begins, so a search whose driver is lost goes on from its last generation and asks nothing twice.
"""

from __future__ import annotations

import random
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerisk.functions.durable import checkpoint_folder, durable
from tablerisk.operators.metrics import generation_log
from tablerisk.operators.models import population_fitness
from tablerisk.operators.overlay import Overlay
from tablerisk.plans.answer_store import AnswerStore, dataset_labels, formatted, members_table
from tablerisk.sources.batches import BatchTable
from tablerisk.spec import Mechanism

PERFECT = 0.9999
PERFECT_GENERATIONS = 10
GENERATION = "rank int, queries array<array<int>>, fitness_train double, fitness_eval double, fitness_min double"


@dataclass(frozen=True)
class SearchConfig:
    """Sizes and probabilities of a search."""

    population_size: int = 100
    num_queries: int = 100
    num_generations: int = 200
    frac_elitism: float = 0.1
    p_copy: float = 0.025
    p_modify: float = 0.025
    p_switch: float = 0.025
    p_swap: float = 0.025
    mode: str = "evolutionary"
    model: str = "logreg"
    seed: int = 0

    def __post_init__(self):
        if self.mode not in ("evolutionary", "random"):
            raise ValueError(f"unknown search mode {self.mode!r}")
        if self.model not in ("logreg", "mlp"):
            raise ValueError(f"unknown fitness model {self.model!r}")

    @property
    def num_elites(self) -> int:
        return 1 if self.mode == "random" else int(self.population_size * self.frac_elitism)


class QuerySearch:
    """Evolutionary (or purely random) search over solutions = lists of queries."""

    def __init__(self, store: AnswerStore, labels: DataFrame, config: SearchConfig, folder: str | None = None):
        self.store, self.labels, self.config = store, durable(labels), config
        self.rng = random.Random(config.seed)
        self.width = len(store.columns)
        self.population: list[list[tuple]] = []
        self.scores: list[tuple[float, float, float]] = []
        self.perfect = 0
        folder = folder or f"{checkpoint_folder(store.spark).rstrip('/')}/search-{uuid.uuid4()}"
        self.generations = BatchTable(store.spark, folder, GENERATION)

    def random_solution(self) -> list[tuple]:
        return [
            tuple(self.rng.randint(-1, 1) for _ in range(self.width))
            for _ in range(self.config.num_queries)
        ]

    def score(self, solutions: list[list[tuple]]) -> list[tuple[float, float, float]]:
        """Fitness of new solutions: one job for the missing answers, one for all the fits."""
        listed = [formatted(s, self.store.mechanism) for s in solutions]
        self.store.update({entry for s in listed for entry in s})
        members = members_table(self.store.spark, listed)
        fitness = population_fitness(
            members, self.store.rows(members), self.labels, self.config.model, self.config.seed
        )
        found = {r["solution_id"]: r for r in fitness.collect()}  # one row per solution
        names = ("fitness_train", "fitness_eval", "fitness_min")
        return [tuple(found[i][n] for n in names) for i in range(len(solutions))]

    def add(self, kept: int, solutions: list[list[tuple]]) -> None:
        """Keep the first ``kept`` scored solutions, score the new ones, sort by the lower score."""
        scores = self.scores[:kept] + self.score(solutions)
        population = self.population[:kept] + solutions
        order = sorted(range(len(population)), key=lambda i: (-scores[i][2], i))
        self.population = [population[i] for i in order]
        self.scores = [scores[i] for i in order]

    def offspring(self) -> list[list[tuple]]:
        free = self.config.population_size - self.config.num_elites
        if self.config.mode == "random":
            return [self.random_solution() for _ in range(free)]
        weights = [s[2] for s in self.scores]
        weights = weights if sum(weights) > 0 else [1.0] * len(weights)
        parents = self.rng.choices(self.population, weights=weights, k=free)
        return [self.mutated(p) for p in parents]

    def mutated(self, parent: list[tuple]) -> list[tuple]:
        """Copy, modify or keep each query; shuffle; cut back to the allowed number."""
        c, out = self.config, []
        for query in parent:
            kind = self.rng.random()
            if kind < c.p_copy:
                changed = self.store.mechanism.deterministic or self.rng.random() < 0.5
                out += [query, self.modified(query) if changed else query]
            elif kind < c.p_copy + c.p_modify:
                out.append(self.modified(query))
            else:
                out.append(query)
        self.rng.shuffle(out)
        return out[: c.num_queries]

    def modified(self, query: tuple) -> tuple:
        """Walk the positions in random order: switch one condition, or swap it with the next."""
        order = list(range(len(query)))
        self.rng.shuffle(order)
        out, i = list(query), 0
        while i < len(order):
            kind, here = self.rng.random(), order[i]
            i += 1
            if kind < self.config.p_switch:
                out[here] = (query[here] + 1 + self.rng.randint(1, 2)) % 3 - 1
            elif kind < self.config.p_switch + self.config.p_swap and i < len(order):
                out[here], out[order[i]] = query[order[i]], query[here]
                i += 1
        return tuple(out)

    def run(self) -> "QuerySearch":
        """Search until the last generation or a run of perfect ones, from the last stored generation on."""
        self.restore()
        for generation in range(len(self.generations.batches), self.config.num_generations + 1):
            if self.perfect == PERFECT_GENERATIONS:
                break
            if generation == 0:
                self.add(0, [self.random_solution() for _ in range(self.config.population_size)])
            else:
                self.add(self.config.num_elites, self.offspring())
            best = max(s[1] for s in self.scores)
            self.perfect = self.perfect + 1 if best >= PERFECT else 0
            self.keep()
        return self

    def keep(self) -> None:
        """Store the generation, its scores and the random state that the next one starts from."""
        rows = [(i, [list(q) for q in p], *s) for i, (p, s) in enumerate(zip(self.population, self.scores))]
        version, state, gauss = self.rng.getstate()
        note = {"random": [version, list(state), gauss], "perfect": self.perfect, "asked": self.store.asked}
        self.generations.append(self.store.spark.createDataFrame(rows, GENERATION).coalesce(1), note)

    def restore(self) -> None:
        """Continue from the last stored generation, if there is one."""
        if not self.generations.batches:
            return
        last = self.generations.batches[-1]
        note = self.generations.notes[last]
        rows = sorted(self.generations.read([last]).collect(), key=lambda r: r["rank"])  # the population
        self.population = [[tuple(q) for q in r["queries"]] for r in rows]
        self.scores = [(r["fitness_train"], r["fitness_eval"], r["fitness_min"]) for r in rows]
        version, state, gauss = note["random"]
        self.rng.setstate((version, tuple(state), gauss))
        self.perfect = note["perfect"]

    def fitness_table(self) -> DataFrame:
        """generation, rank, fitness_train, fitness_eval, fitness_min, as stored."""
        return self.generations.read().select(
            F.col("batch").cast("bigint").alias("generation"),
            F.col("rank").cast("bigint").alias("rank"),
            "fitness_train",
            "fitness_eval",
            "fitness_min",
        )

    def log(self) -> DataFrame:
        """Mean and maximum fitness per generation."""
        return generation_log(self.fitness_table())

    def best_solution(self) -> DataFrame:
        """The best solution -> pos, conditions, variant."""
        rows = [
            (pos, list(q), variant)
            for pos, (q, variant) in enumerate(formatted(self.population[0], self.store.mechanism))
        ]
        return self.store.spark.createDataFrame(
            rows, "pos bigint, conditions array<int>, variant bigint"
        )


def query_search(
    tables: DataFrame | Overlay,
    columns: Sequence[str],
    target: DataFrame,
    target_id: int,
    mechanism: Mechanism,
    config: SearchConfig,
    folder: str | None = None,
) -> QuerySearch:
    """Run a search on shadow datasets (phase, dataset_id, record_id, columns..., sensitive).

    Answers and generations lie under ``folder``; a search with the same inputs and folder continues there.
    """
    store = AnswerStore(tables, columns, target, mechanism, config.seed, folder and f"{folder}/answers")
    labels = dataset_labels(tables, target_id)
    return QuerySearch(store, labels, config, folder and f"{folder}/generations").run()
