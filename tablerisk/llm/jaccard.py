"""N-gram Jaccard join with rare-first prefixes and length, positional and suffix filters.

Documents with equal shingle sets form one class and take part once. All shingles are counted, and a
class's shingles are ordered rare first; two sets as similar as asked share a shingle among their
first few, so classes meet on these prefix shingles only, and shingles that occur once are left out. In a first pass every class of a prefix shingle meets one
class there, which is linear in the group; what is linked then counts as one component. In a second
pass only classes of different components meet, so a group of near copies costs no pairs, and no
link between components is lost. Filters drop most candidates, and each pair left is verified once on
the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablerisk.llm.components import components
from tablerisk.llm.hashindex import HashIndex, added, hash_shard, squeezed, unsqueezed, write_index
from tablerisk.llm.store import growing, new_folder, stored
from tablerisk.llm.text import mix, shingles, signed, slices, words

CODE_BITS = 36
FLUSH = 4_000_000
PARTS = 8
HISTOGRAM = [f"h{k}" for k in range(PARTS)]


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending, with the bounds of the texts."""
    found = words(column, lower=True)
    value, owner = shingles(found.hashes(), found.first, size)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(column) + 1))


def set_keys(value: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """One 64-bit key per set; the empty set has key 0."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(value + np.uint64(0x632BE59BD9B4E019)))))
    size = np.diff(bound)
    key = mix(sums[bound[1:]] - sums[bound[:-1]] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.where(size > 0, key | np.uint64(1), np.uint64(0))


def needed(size: Column | np.ndarray, percent: int):
    """Shingles of a set that must be in the other one: the ceiling of percent of its size."""
    return (size * percent + 99) // 100 if isinstance(size, np.ndarray) else F.ceil(size * percent / 100)


def overlap(a: Column, b: Column, percent: int) -> Column:
    """Least common shingles of two linked sets."""
    return F.ceil((a + b) * F.lit(percent) / F.lit(100 + percent))


def document_sets(documents: DataFrame, size: int) -> DataFrame:
    """(doc, row, key, n): each document's set key and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                value, bound = shingle_sets(part.column("text"), size)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), part.column("row"), pa.array(signed(set_keys(value, bound))), pa.array(np.diff(bound))],
                    ["doc", "row", "key", "n"],
                )

    return documents.select("doc", "row", "text").mapInArrow(run, "doc long, row long, key long, n long")


def write_counts(documents: DataFrame, size: int, shards: int, folder: str) -> None:
    """Index of the shingles that occur in more than one document, with their count up to 255.

    Counted are ``CODE_BITS`` leading bits of the hashes; what is unique there is unique. Counts order
    prefixes and leave out unique shingles, so shared codes cost time and change no link.
    """
    shift = np.uint64(64 - CODE_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for part in slices(batch, "text"):
                held.append(shingle_sets(part.column("text"), size)[0] >> shift << shift)
                if sum(map(len, held)) > FLUSH:
                    yield blobs(np.concatenate(held), shards)
                    held = []
        if held:
            yield blobs(np.concatenate(held), shards)

    def entries(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        counts = [np.frombuffer(zstandard.decompress(c), np.uint32) for c in pdf["counts"]]
        code, n = added([unsqueezed(k) << shift for k in pdf["keys"]], counts)
        return code[n > 1], np.minimum(n[n > 1], 255)

    rows = documents.select("text").mapInArrow(run, "shard int, keys binary, counts binary")
    write_index(rows, entries, shards, folder, int(shift))


def blobs(codes: np.ndarray, shards: int) -> pa.RecordBatch:
    """Distinct codes and counts of a task by shard."""
    code, n = np.unique(codes, return_counts=True)
    bounds = np.searchsorted(hash_shard(code, shards), np.arange(shards + 1))
    rows = [
        (s, squeezed(code[a:b] >> np.uint64(64 - CODE_BITS)), zstandard.compress(n[a:b].astype(np.uint32), 1))
        for s, (a, b) in enumerate(zip(bounds, bounds[1:]))
        if b > a
    ]
    columns = list(zip(*rows)) or [[]] * 3
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], ["shard", "keys", "counts"]
    )


def prefixes(documents: DataFrame, size: int, percent: int, shards: int, folder: str) -> DataFrame:
    """(shingle, key, n, m, place) of each distinct set's prefix in rare-first order, but for unique shingles.

    ``m`` is the number of the set's shingles that are not unique, which is all it can share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = HashIndex(folder, shards, 64 - CODE_BITS)
        for batch in batches:
            seen = np.zeros(0, np.uint64)
            for part in slices(batch, "text"):
                value, bound = shingle_sets(part.column("text"), size)
                keys = set_keys(value, bound)
                # Copies within a batch go out once, so a large group of copies is small before the shuffle.
                new = np.zeros(len(keys), bool)
                new[np.unique(keys, return_index=True)[1]] = True
                new &= ~np.isin(keys, seen)
                seen = np.concatenate((seen, keys[new]))
                n = np.diff(bound)
                value, n, keys = value[np.repeat(new, n)], n[new], keys[new]
                bound = np.concatenate(([0], np.cumsum(n)))
                owner = np.repeat(np.arange(len(n)), n)
                count = index.numbers(value)
                rare = np.lexsort((value, count, owner))
                value, count = value[rare], count[rare]
                place = np.arange(len(value)) - np.repeat(bound[:-1], n)
                shared = np.bincount(owner[count > 0], minlength=len(n))
                keep = (place < np.repeat(n - needed(n, percent) + 1, n)) & (count > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(value[keep])),
                        pa.array(signed(keys[owner[keep]])),
                        pa.array(n[owner[keep]].astype(np.int32)),
                        pa.array(shared[owner[keep]].astype(np.int32)),
                        pa.array(place[keep].astype(np.int32)),
                    ],
                    ["shingle", "key", "n", "m", "place"],
                )

    rows = documents.mapInArrow(run, "shingle long, key long, n int, m int, place int")
    return rows.distinct()


def set_rows(documents: DataFrame, size: int) -> DataFrame:
    """(key, n, h0.., shingles): the set of each document as ascending 64-bit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                value, bound = shingle_sets(part.column("text"), size)
                raw = value.astype("<u8").tobytes()
                owner = np.repeat(np.arange(len(part)), np.diff(bound))
                counts = np.zeros((len(part), PARTS), np.int64)
                np.add.at(counts, (owner, (value >> np.uint64(61)).astype(int)), 1)
                columns = [pa.array(signed(set_keys(value, bound))), pa.array(np.diff(bound))]
                columns += [pa.array(counts[:, k]) for k in range(PARTS)]
                columns.append(pa.array([raw[8 * a : 8 * b] for a, b in zip(bound, bound[1:])], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["key", "n", *HISTOGRAM, "shingles"])

    parts = ", ".join(f"{h} long" for h in HISTOGRAM)
    return documents.select("doc", "text").mapInArrow(run, f"key long, n long, {parts}, shingles binary")


def may_link(percent: int) -> Column:
    """Length and positional filter on two classes that met on a shingle.

    What stands before the shingle in either order is not shared, nor are unique shingles.
    """
    lengths = (100 * F.least("na", "nb")) >= (percent * F.greatest("na", "nb"))
    after = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"), F.col("ma"), F.col("mb"))
    return lengths & (after >= overlap(F.col("na"), F.col("nb"), percent))


def filtered(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) that may link."""
    return pairs.where(may_link(percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are as similar as asked, after the suffix filter on their parts."""
    a = sets.select([F.col(c).alias(f"a_{c}") for c in sets.columns])
    b = sets.select([F.col(c).alias(f"b_{c}") for c in sets.columns])
    counts = [c for c in sets.columns if c != "shingles"]
    least = sum((F.least(f"a_{h}", f"b_{h}") for h in HISTOGRAM), F.lit(0))
    near = pairs.join(growing(a.select([f"a_{c}" for c in counts])), F.col("a") == F.col("a_key"))
    near = near.join(growing(b.select([f"b_{c}" for c in counts])), F.col("b") == F.col("b_key"))
    # Sets that share a shingle share its part of the hash range, which bounds what they share in all.
    near = near.where(least >= overlap(F.col("a_n"), F.col("b_n"), percent)).select("a", "b")
    both = near.join(growing(a.select("a_key", "a_shingles")), F.col("a") == F.col("a_key"))
    both = both.join(growing(b.select("b_key", "b_shingles")), F.col("b") == F.col("b_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("a_shingles"), batch.column("b_shingles")):
                x, y = (np.frombuffer(s.as_buffer(), "<u8") for s in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * shared >= percent * (len(x) + len(y) - shared))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(keep)

    return both.select("a", "b", "a_shingles", "b_shingles").mapInArrow(run, "a long, b long")


def similar_documents(
    documents: DataFrame, size: int = 3, percent: int = 90
) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_key) of every row.

    Lower-case ASCII letters, words between ASCII white space, distinct shingles of ``size`` words; a
    shorter text is one shingle of all its words. Documents link when
    100 * intersection >= percent * union. Null or empty texts have no shingle and link with nothing, so
    each is its own component. Rows with a null doc_id link others but get no component of their
    own. Rows that repeat a doc_id are the same node. Other columns are ignored; an empty table gives
    an empty one.
    """
    folder = new_folder(documents.sparkSession, "jaccard")
    # Texts are fetched by doc_id, those of rows without one by their hash.
    doc = F.col("doc_id").cast("long")
    docs = documents.select(doc.alias("doc"), F.coalesce(doc, F.xxhash64("text")).alias("row"), "text")
    shards = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    write_counts(docs, size, shards, f"{folder}/counts")
    held = stored(document_sets(docs, size), f"{folder}/documents")
    prefix = stored(prefixes(docs, size, percent, shards, f"{folder}/counts"), f"{folder}/prefixes")
    head = F.min(F.struct("place", "key", "n", "m")).alias("head")
    shared = prefix.groupBy("shingle").agg(head, F.min("key").alias("first"), F.max("key").alias("last"))
    met = prefix.join(growing(shared.where("first < last").select("shingle", "head")), "shingle")
    met = stored(met, f"{folder}/met")
    # First pass: each class against the class of its prefix shingle that has fewest rarer ones. Among
    # near copies that is the one with fewest changes, so most others link with it.
    star = met.where(F.col("key") != F.col("head.key")).select(
        F.col("head.key").alias("a"), F.col("key").alias("b"), F.col("head.n").alias("na"), F.col("n").alias("nb"),
        F.col("head.m").alias("ma"), F.col("m").alias("mb"), F.col("head.place").alias("pa"), F.col("place").alias("pb"),
    )
    tried = stored(filtered(star, percent), f"{folder}/star-pairs")
    # The sets of classes that met another one, each from the row that comes first.
    classes = met.select("key").distinct()
    owners = held.groupBy("key").agg(F.min("row").alias("owner")).join(growing(classes), "key", "left_semi")
    texts = docs.join(growing(owners.select(F.col("owner").alias("row")).distinct()), "row", "left_semi")
    sets = set_rows(texts, size).join(growing(classes), "key", "left_semi").dropDuplicates(["key"])
    sets = stored(sets, f"{folder}/sets")
    linked = stored(verified(tried, sets, percent), f"{folder}/star-links")
    # Second pass: classes of one prefix shingle that are not yet in one component.
    part = stored(components(linked, f"{folder}/first"), f"{folder}/first-components")
    placed = met.join(growing(part), met["key"] == part["node"], "left").withColumn(
        "component", F.coalesce("component", "key")
    )
    mixed = placed.groupBy("shingle").agg(F.min("component").alias("c0"), F.max("component").alias("c1"))
    placed = placed.join(growing(mixed.where("c0 < c1").select("shingle")), "shingle", "left_semi")
    placed = stored(placed.select("shingle", "key", "n", "m", "place", "component"), f"{folder}/mixed")
    a = placed.toDF("shingle", "a", "na", "ma", "pa", "ca")
    b = placed.toDF("shingle", "b", "nb", "mb", "pb", "cb")
    fits = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & may_link(percent)
    more = a.join(growing(b), "shingle").where(fits).select("a", "b").distinct()
    more = stored(more.join(growing(tried), ["a", "b"], "left_anti"), f"{folder}/more-pairs")
    links = linked.union(verified(more, sets, percent))
    return grouped_documents(held, links, folder)


def grouped_documents(held: DataFrame, links: DataFrame, folder: str) -> DataFrame:
    """Bring components of classes back to documents and name each by its smallest doc_id."""
    joint = stored(components(links, f"{folder}/second"), f"{folder}/components")
    found = held.join(growing(joint), held["key"] == joint["node"], "left")
    found = found.withColumn("class", F.coalesce("component", "key"))
    names = found.where(F.col("n") > 0).groupBy("class").agg(F.min("doc").alias("name"))
    named = found.join(growing(names), "class", "left")
    return named.select(
        F.col("doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc").isNull(), None).when(F.col("n") > 0, F.col("name")).otherwise(F.col("doc")).alias("component_id"),
        F.col("key").alias("set_key"),
    )
