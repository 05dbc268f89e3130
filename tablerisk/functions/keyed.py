"""Keyed-hash randomness as Column expressions.

Every random choice in the package is a pure function of (seed, keys, stream), so a retried
task, another partitioning or another engine draws exactly the same values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the 32-bit integer mix.
MIX_FACTOR = 73244475
MASK32 = 4294967295

TWO32 = 4294967296.0
TWO53 = 9007199254740992.0


def mix_int(x: int) -> int:
    """The integer mix on a Python int (used to fold constants at plan time)."""
    for _ in range(2):
        x = (((x >> 16) ^ x) * MIX_FACTOR) & MASK32
    return (x >> 16) ^ x


def mix(x: str) -> str:
    """The integer mix as SQL text over a bigint expression with values in [0, 2^32)."""
    for _ in range(2):
        x = f"(((shiftright({x}, 16) ^ {x}) * {MIX_FACTOR}L) & {MASK32}L)"
    return f"(shiftright({x}, 16) ^ {x})"


def fold32(key: str) -> str:
    """Fold a 64-bit key to 32 bits; keys below 2^32 are unchanged."""
    return f"((cast({key} as bigint) & {MASK32}L) ^ shiftrightunsigned(cast({key} as bigint), 32))"


def mixed_id(key: str) -> Column:
    """The mix of one (folded) id, the per-record term of a user-set hash."""
    return F.expr(mix(f"({fold32(key)})"))


def keyed_hash(seed: int, key: str, stream: int) -> Column:
    """32-bit hash of one key column, for use inside a single expression."""
    level = mix(f"(({fold32(key)} + {mix_int(seed + 1) + 1}L) & {MASK32}L)")
    return F.expr(mix(f"(({level} + {stream}L) & {MASK32}L)"))


def with_hashes(
    df: DataFrame, seed: int, keys: list[str], streams: dict[str, int]
) -> DataFrame:
    """Add one 32-bit hash column per entry of ``streams`` (name -> stream number).

    ``keys`` are SQL expressions, folded in one after the other. Every step is a named column of
    the same projection that later steps refer to: written as one expression, each mix would
    repeat its argument eight times.
    """
    steps, state = [], f"{mix_int(seed + 1)}L"
    for i, key in enumerate(keys):
        steps.append(f"({state} + {fold32(key)} + 1L) & {MASK32}L AS __fold{i}")
        steps.append(f"{mix(f'__fold{i}')} AS __state{i}")
        state = f"__state{i}"
    for name, stream in streams.items():
        steps.append(f"({state} + {stream}L) & {MASK32}L AS __fold_{name}")
        steps.append(f"{mix(f'__fold_{name}')} AS {name}")
    kept = [F.col(f"`{c}`") for c in df.columns]
    return df.selectExpr("*", *steps).select(*kept, *streams)


def uniform(h: Column) -> Column:
    """Uniform in (0, 1) from one 32-bit hash; neither end can occur."""
    return (h + F.lit(0.5)) / F.lit(TWO32)


def gaussian(h1: Column, h2: Column) -> Column:
    """Standard normal by Box-Muller from two hashes."""
    return F.sqrt(F.lit(-2.0) * F.log(uniform(h1))) * F.cos(F.lit(2 * math.pi) * uniform(h2))


def laplace(h: Column) -> Column:
    """Laplace(0, 1) by inverting its distribution function."""
    centred = uniform(h) - F.lit(0.5)
    return -F.signum(centred) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(centred))


def uniform_integer(h: Column, c: int) -> Column:
    """Uniform integer in [-c, c]."""
    return F.floor(uniform(h) * F.lit(2 * c + 1)).cast("bigint") - F.lit(c)


# Stream numbers, one per use.
STREAM_INDEX = 11
STREAM_DRAW_HIGH = 23
STREAM_DRAW_LOW = 29
STREAM_RANK = 31
STREAM_BIT = 41
STREAM_NORMAL_1 = 101
STREAM_NORMAL_2 = 211
STREAM_STICKY = 307
STREAM_LAPLACE = 401
STREAM_QUERY = 503
STREAM_SYNTH = 601
STREAM_NET = 701
