"""Sorted hashes with a small number each, in mapped shards that tasks look up.

The index grows with the data, so it is neither collected nor broadcast: Spark groups hashes by shard,
each group writes Elias-Fano files to the shared folder, and tasks map them into memory.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from tablerisk.llm.eliasfano import EliasFano
from tablerisk.llm.store import Folder


def hash_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards are equal ranges of the 64-bit hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def squeezed(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed byte planes of their differences."""
    planes = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(np.ascontiguousarray(planes), 1)


def unsqueezed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their summed counts."""
    key = np.concatenate(keys or [np.zeros(0, np.uint64)])
    distinct, at = np.unique(key, return_inverse=True)
    weight = np.concatenate(counts) if counts else np.zeros(0)
    return distinct, np.bincount(at, weight, len(distinct)).astype(np.int64)


def write_index(
    rows: DataFrame, entries: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]], shards: int, folder: str, shift: int = 0
) -> None:
    """Write what ``entries`` makes of each ``shard`` group of ``rows``: ascending hashes and numbers below 256.

    ``shift`` low bits of the hashes are not kept.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = int(pdf["shard"].iloc[0])
        write_shard(Folder(folder), s, *entries(pdf), shift)
        return pd.DataFrame({"shard": [s]})

    done = {r["shard"] for r in rows.groupBy("shard").applyInPandas(run, "shard int").collect()}  # one row a shard
    for s in set(range(shards)) - done:
        write_shard(Folder(folder), s, np.zeros(0, np.uint64), np.zeros(0, np.uint8), shift)


def write_shard(target: Folder, s: int, hashes: np.ndarray, numbers: np.ndarray, shift: int) -> None:
    EliasFano.write(hashes >> np.uint64(shift), target.write, f"hashes-{s:05d}")
    target.write(f"hashes-{s:05d}.number", numbers.astype(np.uint8))


class HashIndex:
    """Looks up the numbers of hashes."""

    def __init__(self, folder: str, shards: int, shift: int = 0):
        source = Folder(folder)
        self.shards, self.shift = shards, np.uint64(shift)
        self.parts = [
            (EliasFano(source.array, f"hashes-{s:05d}"), source.array(f"hashes-{s:05d}.number", np.uint8))
            for s in range(shards)
        ]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, 0 for one that the index does not hold."""
        out = np.zeros(len(hashes), np.uint8)
        shard = hash_shard(hashes, self.shards)
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s, (sequence, number) in enumerate(self.parts):
            own = order[bounds[s] : bounds[s + 1]]
            if len(own):
                at = sequence.find(hashes[own] >> self.shift)
                out[own[at >= 0]] = number[at[at >= 0]]
        return out
