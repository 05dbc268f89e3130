"""Counts of conditional queries for many literal rows, by equi-joins alone.

Every query is rewritten into signed counts of equalities: "not equal" is present minus equal, and a range is a set of
dyadic intervals of the column's value ranks, at most one a level. What is left are counts of records per projection
(which columns are fixed) and projected tuple, grouped once with map-side combining, to which the literals' own
projected tuples are joined. Work grows with records + literals, each times the projections that the queries use;
records never meet literals that differ from them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablerisk.functions.durable import broadcast_if_small, durable
from tablerisk.functions.ranks import bucketed_rank

# What a pattern fixes of a column: nothing, its value, that it is present, values below the literal, values up to it.
ANY, EQUAL, PRESENT, BELOW, UPTO = "01234"
# Signed patterns whose counts add up to each condition code's count.
TERMS = {
    0: [(ANY, 1)],
    1: [(EQUAL, 1)],
    -1: [(PRESENT, 1), (EQUAL, -1)],
    -2: [(BELOW, 1)],
    -3: [(UPTO, 1)],
    2: [(PRESENT, 1), (UPTO, -1)],
    3: [(PRESENT, 1), (BELOW, -1)],
}
RANK_BUCKETS = 4096
SMALL_PROJECTION = 1000


def signed_terms(queries: DataFrame, n_columns: int) -> DataFrame:
    """query_id, pattern, sign: a query's count is the signed sum of its patterns' counts.

    Each query also has the pattern that fixes nothing with sign 0, so that it is answered where nothing matches.
    """
    rows = queries.select("query_id", "conditions", F.lit("").alias("pattern"), F.lit(1).alias("sign"))
    for i in range(n_columns):
        code = F.element_at("conditions", i + 1)
        kind = "array<struct<kind: string, factor: int>>"
        options = F.raise_error(F.concat(F.lit("unknown condition in query "), "query_id")).cast(kind)
        for condition, terms in TERMS.items():
            known = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("factor")) for k, s in terms])
            options = F.when(code == condition, known).otherwise(options)
        rows = rows.withColumn("__o", F.explode(options)).select(
            "query_id",
            "conditions",
            F.concat("pattern", "__o.kind").alias("pattern"),
            (F.col("sign") * F.col("__o.factor")).alias("sign"),
        )
    nothing = queries.select("query_id", F.lit(ANY * n_columns).alias("pattern"), F.lit(0).alias("sign"))
    return rows.select("query_id", "pattern", "sign").unionByName(nothing)


def shape_of(pattern: Column) -> Column:
    """The projection that answers a pattern: both kinds of ranges use the same intervals."""
    return F.translate(pattern, UPTO, BELOW)


def with_patterns(rows: DataFrame, patterns: Sequence[str], name: str) -> DataFrame:
    """Every row once per pattern; the patterns are a stated set, at most one per kind of query."""
    return rows.withColumn(name, F.explode(F.split(F.lit(",".join(patterns)), ",")))


def as_text(column: str) -> Column:
    """A value as a part of a key; both zeros of a double are one value."""
    return (F.col(column) + F.lit(0)).cast("string")


def value_ranks(reduced: DataFrame, literals: DataFrame, column: str) -> tuple[DataFrame, int]:
    """The column's distinct values in records and literals with their ranks, and the number of dyadic levels above 0."""
    values = reduced.select(column).unionByName(literals.select(column)).filter(F.col(column).isNotNull()).distinct()
    values = durable(values)
    n, low, high = values.agg(F.count(F.lit(1)), F.min(column), F.max(column)).first()
    span = float(high) - float(low) if n else 0.0
    bucket = F.lit(0).cast("bigint")
    if math.isfinite(span) and span > 0:
        bucket = F.floor((F.col(column).cast("double") - F.lit(float(low))) / F.lit(span) * RANK_BUCKETS)
    return bucketed_rank(values, [], bucket, [F.col(column)], f"__r_{column}"), n.bit_length()


def projected_counts(
    reduced: DataFrame, columns: Sequence[str], shapes: Sequence[str], levels: dict[str, int], keys: Sequence[str]
) -> DataFrame:
    """shape, place, keys, cnt, set_hash: records per projection and projected tuple."""
    rows = with_patterns(reduced, shapes, "shape")
    parts = []
    for i, c in enumerate(columns):
        kind, value = F.substring("shape", i + 1, 1), as_text(c)
        present = F.when(F.col(c).isNotNull(), F.lit("+"))
        part = F.when(kind == ANY, "").when(kind == EQUAL, value).when(kind == PRESENT, present)
        if c in levels:
            nodes = F.expr(f"transform(sequence(0, {levels[c]}), l -> concat(l, '.', shiftright(`__r_{c}`, l)))")
            options = F.when(kind == BELOW, F.when(F.col(f"__r_{c}").isNotNull(), nodes)).otherwise(F.array(part))
            rows = rows.withColumn(f"__p{i}", F.explode(options))
        else:
            rows = rows.withColumn(f"__p{i}", part)
        parts.append(F.col(f"__p{i}"))
    present = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts])
    place = F.concat_ws("|", "shape", *parts)
    return (
        rows.filter(present)
        .select("shape", place.alias("place"), *keys, "cnt", "set_hash")
        .groupBy("shape", "place", *keys)
        .agg(F.sum("cnt").alias("cnt"), F.bit_xor("set_hash").alias("set_hash"))
    )


def asked_places(literals: DataFrame, columns: Sequence[str], patterns: Sequence[str], levels: dict[str, int]) -> DataFrame:
    """literal, pattern, place: the projected tuples whose counts make up each literal's patterns.

    A missing value fails every condition, so it has no place in a pattern that fixes its column.
    """
    rows = with_patterns(literals, patterns, "pattern")
    parts = []
    for i, c in enumerate(columns):
        kind, value = F.substring("pattern", i + 1, 1), as_text(c)
        present = F.when(F.col(c).isNotNull(), F.lit("+"))
        part = F.when(kind == ANY, "").when(kind == EQUAL, value).when(kind == PRESENT, present)
        if c in levels:
            end = f"(`__r_{c}` + IF(substring(pattern, {i + 1}, 1) = '{UPTO}', 1, 0))"
            nodes = F.expr(
                f"transform(filter(sequence(0, {levels[c]}), l -> shiftright({end}, l) % 2 = 1), "
                f"l -> concat(l, '.', shiftright({end}, l) - 1))"
            )
            ranged = kind.isin(BELOW, UPTO)
            options = F.when(ranged, F.when(F.col(f"__r_{c}").isNotNull(), nodes)).otherwise(F.array(part))
            rows = rows.withColumn(f"__p{i}", F.explode(options))
        else:
            rows = rows.withColumn(f"__p{i}", part)
        parts.append(F.col(f"__p{i}"))
    present = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts])
    place = F.concat_ws("|", shape_of(F.col("pattern")), *parts)
    return rows.filter(present).select("literal", "pattern", place.alias("place"))


def joined_counts(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts beside the places that ask for them.

    Many literals ask for the same place only in projections with few places: those are broadcast if all of them
    together are few rows, and only the others are shuffled by place.
    """
    sizes = counts.groupBy("shape").count().withColumn("small", F.col("count") <= SMALL_PROJECTION)
    marked = counts.join(broadcast_if_small(sizes.select("shape", "small")), "shape")
    few = broadcast_if_small(marked.filter("small").drop("shape", "small"))
    many = marked.filter("not small").drop("shape", "small")
    return asked.join(few, "place").unionByName(asked.join(many, "place")).drop("place")


def projection_counts(
    reduced: DataFrame, columns: Sequence[str], queries: DataFrame, values: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """Answer every query with every value row -> keys, value_id, query_id, cnt, set_hash.

    ``reduced`` holds distinct records (keys, columns, cnt, set_hash); ``values`` holds value_id and columns of the same
    types. Equal literal rows are answered once. Only the query set's patterns and one row a ranged column reach the driver.
    """
    columns, keys = list(columns), list(keys)
    if values.groupBy("value_id").count().filter("count > 1").limit(1).count():
        raise ValueError("value_id must be unique")
    terms = durable(signed_terms(queries, len(columns)))
    patterns = sorted(r[0] for r in terms.select("pattern").distinct().collect())  # a stated set
    literal = F.concat_ws("|", *[F.coalesce(as_text(c), F.lit("~")) for c in columns])
    values = values.withColumn("literal", literal)
    literals = values.select("literal", *columns).dropDuplicates(["literal"])
    reduced, literals = durable(reduced), durable(literals)
    levels = {}
    for i, c in enumerate(columns):
        if any(p[i] in (BELOW, UPTO) for p in patterns):
            ranks, levels[c] = value_ranks(reduced, literals, c)
            ranks = broadcast_if_small(durable(ranks))
            reduced, literals = reduced.join(ranks, c, "left"), literals.join(ranks, c, "left")
    shapes = sorted({p.replace(UPTO, BELOW) for p in patterns})
    counts = projected_counts(reduced, columns, shapes, levels, keys)
    if not keys:  # an empty table still answers 0
        nothing = ANY * len(columns)
        zero = "".join(["|"] * len(columns))
        empty = counts.sparkSession.range(1).select(
            F.lit(nothing).alias("shape"), F.lit(nothing + zero).alias("place"),
            *[F.lit(0).cast("bigint").alias(c) for c in ("cnt", "set_hash")],
        )
        counts = counts.unionByName(empty)
    found = joined_counts(asked_places(literals, columns, patterns, levels), durable(counts))
    signed = found.join(broadcast_if_small(terms), "pattern")
    answers = signed.groupBy(*keys, "literal", "query_id").agg(
        F.sum(F.col("cnt") * F.col("sign")).alias("cnt"),
        F.bit_xor(F.col("set_hash") * F.abs("sign")).alias("set_hash"),
    )
    return answers.join(values.select("value_id", "literal"), "literal").select(*keys, "value_id", "query_id", "cnt", "set_hash")
