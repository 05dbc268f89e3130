"""Batches of conditional COUNT queries and the noise mechanisms that answer them.

A query is one condition code per column; the literals come from a value row. Each record is
reduced to its three-way state per column (below / equal / above the literal), records are counted
by state *before* they meet the queries, and a query matches a state when the state has no bit the
query forbids. The match therefore runs over distinct states, never over rows. Many value rows, and users
who ask with their own rows, are answered from counts per projection instead (``projections.py``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablerisk.functions.durable import BROADCAST_ROWS, broadcast_if_small, durable
from tablerisk.functions.keyed import (
    STREAM_LAPLACE,
    STREAM_NORMAL_1,
    STREAM_NORMAL_2,
    STREAM_STICKY,
    gaussian,
    laplace,
    mix_int,
    mixed_id,
    uniform_integer,
    with_hashes,
)
from tablerisk.operators.projections import projection_counts
from tablerisk.spec import ID, Mechanism

COLUMNS_PER_WORD = 21
VALUE_ROWS = 1000
SPREAD_QUERIES = 2000

# Condition codes: 0 none, 1 ==, -1 !=, 2 >, 3 >=, -2 <, -3 <=.
# State bits of a column: 1 below, 2 equal, 4 above, 7 missing. Forbidden bits per condition:
FORBIDDEN = {0: 0, 1: 5, -1: 2, 2: 3, 3: 1, -2: 6, -3: 4}


def comparable(column: str, int_domain: bool) -> Column:
    """A column as the count engine sees it: truncated to integers, or as doubles."""
    return F.col(f"`{column}`").cast("bigint" if int_domain else "double")


def _words(n_columns: int) -> int:
    return max(1, -(-n_columns // COLUMNS_PER_WORD))


def query_masks(queries: DataFrame, n_columns: int) -> DataFrame:
    """query_id, conditions -> query_id plus one forbidden-bit word per 21 columns."""
    cases = " ".join(f"WHEN {code} THEN {bits}L" for code, bits in FORBIDDEN.items())
    unknown = "cast(raise_error(concat('unknown condition in query ', query_id)) as bigint)"
    words = []
    for w in range(_words(n_columns)):
        bits = [
            f"shiftleft(CASE element_at(conditions, {i + 1}) {cases} ELSE {unknown} END, "
            f"{3 * (i % COLUMNS_PER_WORD)})"
            for i in range(w * COLUMNS_PER_WORD, min((w + 1) * COLUMNS_PER_WORD, n_columns))
        ]
        words.append(f"{' | '.join(bits) or '0L'} AS forbid{w}")
    return queries.selectExpr("query_id", *words)


def column_states(
    df: DataFrame, columns: Sequence[str], literals: Sequence[str], keys: Sequence[str]
) -> DataFrame:
    """Fold ``columns`` compared with ``literals`` (columns) into state words, count per state.

    Expects cnt and set_hash from an earlier reduction; both compose.
    """
    words = []
    for w in range(_words(len(columns))):
        bits = []
        for i in range(w * COLUMNS_PER_WORD, min((w + 1) * COLUMNS_PER_WORD, len(columns))):
            x, v = f"`{columns[i]}`", literals[i]
            bits.append(
                f"shiftleft(CASE WHEN {x} < {v} THEN 1L WHEN {x} = {v} THEN 2L "
                f"WHEN {x} > {v} THEN 4L ELSE 7L END, {3 * (i % COLUMNS_PER_WORD)})"
            )
        words.append(f"{' | '.join(bits) or '0L'} AS state{w}")
    names = [f"state{w}" for w in range(len(words))]
    return (
        df.selectExpr(*keys, *words, "cnt", "set_hash")
        .groupBy(*keys, *names)
        .agg(F.sum("cnt").alias("cnt"), F.bit_xor("set_hash").alias("set_hash"))
    )


def match_queries(
    states: DataFrame, masks: DataFrame, frames: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Sum the states allowed by each query -> keys, query_id, cnt, set_hash (0 when none match).

    ``frames`` lists the key combinations that must be answered. The query side is broadcast only
    if its size allows it; the pair count is distinct states x queries.
    """
    n_words = len([c for c in states.columns if c.startswith("state")])
    allowed = reduce(
        lambda a, b: a & b,
        [F.col(f"state{w}").bitwiseAND(F.col(f"forbid{w}")) == 0 for w in range(n_words)],
    )
    zero = F.lit(0).cast("bigint")
    words = [f"state{w}" for w in range(n_words)]
    empty = frames.select(
        *keys, *[zero.alias(w) for w in words], zero.alias("cnt"), zero.alias("set_hash")
    )
    # a state without bits is allowed by every query: it carries the zero answers
    states = states.select(*keys, *words, "cnt", "set_hash").unionByName(empty)
    n_queries = masks.limit(BROADCAST_ROWS + 1).count()
    if n_queries > SPREAD_QUERIES:
        # few, small state rows fan out to many queries: keep them on all tasks
        states = states.repartition(states.sparkSession.sparkContext.defaultParallelism, *keys, *words)
    if n_queries <= BROADCAST_ROWS:
        masks = F.broadcast(masks)
    return (
        states.join(masks, allowed)
        .groupBy(*keys, "query_id")
        .agg(F.sum("cnt").alias("cnt"), F.bit_xor("set_hash").alias("set_hash"))
    )


def _reduced(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str], int_domain: bool
) -> DataFrame:
    """Count rows (and XOR their id hashes) per distinct combination of the queried columns.

    Rows with a ``weight`` count as often; XOR cancels a row that is lost and gained.
    """
    weight = F.col("weight").cast("bigint") if "weight" in df.columns else F.lit(1).cast("bigint")
    user = mixed_id(f"({ID} + 1)") if ID in df.columns else F.lit(0).cast("bigint")
    return (
        df.select(*keys, *[comparable(c, int_domain).alias(c) for c in columns], user.alias("__u"), weight.alias("__n"))
        .groupBy(*keys, *columns)
        .agg(F.sum("__n").alias("cnt"), F.bit_xor("__u").alias("set_hash"))
    )


def count_queries(
    df: DataFrame,
    columns: Sequence[str],
    queries: DataFrame,
    values: DataFrame,
    keys: Sequence[str] = (),
    int_domain: bool = True,
) -> DataFrame:
    """Answer every query with every value row -> keys, value_id, query_id, cnt, set_hash.

    ``values`` holds value_id and ``columns``. Up to 1000 value rows are literals that every record is compared with once;
    more of them are joined to counts per projection. Both ways give the same answers.
    """
    columns = list(columns)
    reduced = _reduced(df, columns, keys, int_domain)
    literals = values.select("value_id", *[comparable(c, int_domain).alias(c) for c in columns])
    few = literals.limit(VALUE_ROWS + 1).collect()
    if len(few) > VALUE_ROWS:
        return projection_counts(reduced, columns, queries, literals, keys)
    if len({r["value_id"] for r in few}) < len(few):
        raise ValueError("value_id must be unique")
    masks = query_masks(queries, len(columns))
    field_type = "bigint" if int_domain else "double"
    fields = ", ".join(f"v{i}: {field_type}" for i in range(len(columns)))
    packed = F.array(
        *[
            F.struct(
                F.lit(r["value_id"]).cast("bigint").alias("value_id"),
                *[F.lit(r[c]).alias(f"v{i}") for i, c in enumerate(columns)],
            ).cast(f"struct<value_id: bigint, {fields}>")
            for r in few
        ]
    ).cast(f"array<struct<value_id: bigint, {fields}>>")
    asked = reduced.withColumn("__v", F.explode(packed)).withColumn("value_id", F.col("__v.value_id"))
    places = [f"__v.v{i}" for i in range(len(columns))]
    states = column_states(asked, columns, places, [*keys, "value_id"])
    frames = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    frames = frames.select("*", F.explode(packed["value_id"]).alias("value_id"))
    return match_queries(states, masks, frames, [*keys, "value_id"])


def structured_counts(
    df: DataFrame,
    columns: Sequence[str],
    users: DataFrame,
    queries: DataFrame,
    sensitive: str = "sensitive",
    keys: Sequence[str] = (),
    int_domain: bool = True,
) -> DataFrame:
    """Queries whose literals are the given users' own rows -> keys, user_id, query_id, cnt, set_hash.

    ``columns`` ends with the sensitive column, whose literal is always 1. The users' other values
    are the same in every dataset; users absent from the table are not answered.
    """
    if columns[-1] != sensitive:
        raise ValueError("the sensitive column must come last")
    wanted = users.select(F.col("user_id").alias(ID))
    rows = df.join(wanted, ID, "left_semi").dropDuplicates([ID])
    values = rows.select(
        F.col(ID).alias("value_id"),
        *[comparable(c, int_domain).alias(c) for c in columns[:-1]],
        F.lit(1).cast("bigint" if int_domain else "double").alias(sensitive),
    )
    reduced = _reduced(df, columns, keys, int_domain)
    answers = projection_counts(reduced, columns, queries, values, keys)
    return answers.withColumnRenamed("value_id", "user_id")


def target_counts(
    df: DataFrame,
    columns: Sequence[str],
    queries: DataFrame,
    targets: DataFrame,
    keys: Sequence[str],
    int_domain: bool = True,
) -> DataFrame:
    """Each dataset asked only with its own target's values -> keys, query_id, cnt, set_hash.

    ``keys`` contains target_id; ``targets`` holds target_id and ``columns``.
    """
    columns = list(columns)
    reduced = _reduced(df, columns, keys, int_domain)
    literals = targets.select(
        "target_id", *[comparable(c, int_domain).alias(f"__t{i}") for i, c in enumerate(columns)]
    )
    asked = reduced.join(broadcast_if_small(literals), "target_id")
    states = column_states(asked, columns, [f"__t{i}" for i in range(len(columns))], list(keys))
    masks = query_masks(queries, len(columns))
    return match_queries(states, masks, df.select(*keys).distinct(), list(keys))


def overlay_counts(base_states: DataFrame, delta_states: DataFrame, masks: DataFrame, frames: DataFrame) -> DataFrame:
    """Answers on datasets that share a base -> dataset_id, query_id, cnt, set_hash.

    The base is asked once; each dataset adds its own few rows (their counts may be negative).
    """
    keys = ["dataset_id"]
    shared = match_queries(base_states, masks, base_states.sparkSession.range(1).select(), [])
    shared = shared.select("query_id", F.col("cnt").alias("__cnt"), F.col("set_hash").alias("__hash"))
    own = match_queries(delta_states, masks, frames, keys)
    return own.join(broadcast_if_small(durable(shared)), "query_id").select(
        *keys,
        "query_id",
        (F.col("cnt") + F.col("__cnt")).alias("cnt"),
        F.col("set_hash").bitwiseXOR(F.col("__hash")).alias("set_hash"),
    )


def _finish(answer: Column) -> Column:
    """Round half away from zero and clamp at zero."""
    return F.greatest(F.round(answer), F.lit(0.0)).cast("bigint")


def counts_threshold_gaussian(
    counts: DataFrame,
    threshold: int,
    scale: float,
    seed: int,
    keys: Sequence[str] = ("query_id",),
) -> DataFrame:
    """Suppress counts up to ``threshold`` to 0, else add scale * N(0, 1) -> keys, answer."""
    streams = {"__h1": STREAM_NORMAL_1, "__h2": STREAM_NORMAL_2}
    hashed = with_hashes(counts, seed, list(keys), streams)
    noisy = F.col("cnt") + F.lit(float(scale)) * gaussian(F.col("__h1"), F.col("__h2"))
    answer = F.when(F.col("cnt") <= threshold, F.lit(0.0)).otherwise(noisy)
    return hashed.select(*keys, _finish(answer).alias("answer"))


def counts_sticky_uniform(
    counts: DataFrame,
    threshold: int = 4,
    c: int = 2,
    seed: int = 0,
    keys: Sequence[str] = ("query_id",),
) -> DataFrame:
    """Suppress small counts, else add U{-c..c} that depends only on the set of matching users."""
    user_set = f"(set_hash ^ {mix_int(seed + 1)}L)"
    hashed = with_hashes(counts, seed, [user_set], {"__h": STREAM_STICKY})
    noisy = F.col("cnt") + uniform_integer(F.col("__h"), c)
    answer = F.when(F.col("cnt") <= threshold, F.lit(0)).otherwise(noisy)
    return hashed.select(*keys, _finish(answer.cast("double")).alias("answer"))


def counts_dp_laplace(
    counts: DataFrame,
    epsilon: float,
    seed: int,
    budget: str = "budget",
    keys: Sequence[str] = ("query_id",),
) -> DataFrame:
    """Add Lap(1 / (budget * epsilon)) to the exact count; each budget must be in (0, 1]."""
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    hashed = with_hashes(counts, seed, list(keys), {"__h": STREAM_LAPLACE})
    share = F.col(budget)
    valid = F.coalesce((share > 0) & (share <= 1), F.lit(False))
    share = F.when(valid, share).otherwise(
        F.raise_error(F.lit("each budget must be in (0, 1]")).cast("double")
    )
    answer = F.col("cnt") + laplace(F.col("__h")) / (share * F.lit(float(epsilon)))
    return hashed.select(*keys, _finish(answer).alias("answer"))


def apply_mechanism(
    counts: DataFrame, mechanism: Mechanism, seed: int, keys: Sequence[str]
) -> DataFrame:
    """Answer exact counts through the given mechanism."""
    if mechanism.kind == "simple":
        return counts_threshold_gaussian(counts, mechanism.threshold, mechanism.scale, seed, keys)
    if mechanism.kind == "table-builder":
        return counts_sticky_uniform(counts, mechanism.threshold, mechanism.c, seed, keys)
    return counts_dp_laplace(counts, mechanism.epsilon, seed, keys=keys)
