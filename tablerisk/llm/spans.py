"""Substring deduplication by sliding spans of sentences.

Sentences go where a repeated run of at least ``sentences`` sentences and ``min_words`` words covers them,
except in the document that has the run first. Only shortest such runs are hashed and joined over the
whole corpus: from every sentence the fewest that follow, and up to every sentence the fewest before it. Every
longer run is a union of these, its tail included, so what goes is what all runs of every length cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerisk.llm.store import growing, new_folder, stored
from tablerisk.llm.text import BASE, SPACE, mix, powers, signed, slices, words

STOPS = np.zeros(256, bool)
STOPS[list(b".!?")] = True
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))


def sentence_spans(column: pa.Array, sentences: int, min_words: int) -> dict[str, np.ndarray]:
    """Sentences (first word, text) and the spans that start at them (hash, sentence range, text).

    A sentence ends at white space after a full stop, exclamation or question mark, or at a line end.
    Case does not count, nor does the kind of white space. Spans are in the order of their places, none twice.
    """
    found = words(column, lower=True)
    n = len(found.start)
    empty = np.zeros(0, np.int64)
    if n == 0:
        return {"start": empty, "doc": empty, "hash": np.zeros(0, np.uint64), "from": empty, "to": empty, "words": found}
    breaks = np.concatenate(([0], np.cumsum(found.raw == 10)))
    new = np.ones(n, bool)
    new[1:] = (
        STOPS[found.raw[found.end[:-1] - 1]]
        | (breaks[found.start[1:]] > breaks[found.end[:-1]])
        | (found.doc[1:] != found.doc[:-1])
    )
    start = np.flatnonzero(new)
    doc = found.doc[start]
    last = np.searchsorted(doc, doc, "right")  # first sentence of the next text
    begin = np.searchsorted(doc, doc, "left")
    bound = np.append(start, n)
    place = np.arange(len(start))
    ahead = np.maximum(np.searchsorted(bound, start + min_words), place + sentences)
    behind = np.minimum(np.searchsorted(bound, bound[1:] - min_words, "right") - 1, place + 1 - sentences)
    left = np.concatenate((place[ahead <= last], behind[behind >= begin]))
    right = np.concatenate((ahead[ahead <= last], place[behind >= begin] + 1))
    both = np.unique(left * (len(start) + 1) + right, return_index=True)[1]
    left, right = left[both], right[both]
    hashes = found.hashes()
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * powers(n))))
    back = np.ones(n, np.uint64)
    back[1:] = INVERSE
    back = np.multiply.accumulate(back)
    s, e = bound[left], bound[right]
    value = mix((run[e] - run[s]) * back[s] + (e - s).astype(np.uint64) * BASE)
    return {"start": start, "doc": doc, "hash": value, "from": left, "to": right, "words": found}


def first_in_text(found: dict[str, np.ndarray]) -> np.ndarray:
    """Whether each span is its text's first with that hash."""
    own = mix(found["hash"] + found["doc"][found["from"]].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    first = np.zeros(len(own), bool)
    first[np.unique(own, return_index=True)[1]] = True
    return first


def repeated_spans(documents: DataFrame, sentences: int, min_words: int, folder: str) -> DataFrame:
    """(doc, hash) of spans that a document with a smaller doc_id has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = sentence_spans(part.column("text"), sentences, min_words)
                first = first_in_text(found)
                owner = part.column("doc").take(pa.array(found["doc"][found["from"]][first]))
                yield pa.RecordBatch.from_arrays([owner, pa.array(signed(found["hash"][first]))], ["doc", "hash"])

    spans = documents.select(F.col("doc_id").cast("long").alias("doc"), "text").mapInArrow(run, "doc long, hash long")
    spans = spans.where(F.col("doc").isNotNull())
    known = spans.groupBy("hash").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    known = stored(known.where(F.col("first") < F.col("last")).drop("last"), f"{folder}/known")
    return spans.join(growing(known), "hash").where(F.col("doc") > F.col("first")).select("doc", "hash")


def remove_repeated_spans(documents: DataFrame, sentences: int = 2, min_words: int = 20) -> DataFrame:
    """Documents without sentences that a non-first repeated span covers; adds n_sentences, n_removed.

    The first occurrence is that in the smallest doc_id, there the earliest; later occurrences in the
    same document are removed too. Repeated runs of fewer sentences or words stay, since greetings, captions and other
    short turns of phrase recur in unrelated texts. A very long text is cut in one piece. Rows that repeat a doc_id are cut alike, as one document; a null doc_id
    takes no part across documents. Null text stays null with 0 sentences; shorter texts than a
    span stay whole. Other columns are passed on, those named like the added ones are replaced. An
    empty table gives an empty one.
    """
    folder = new_folder(documents.sparkSession, "spans")
    added = ["n_sentences", "n_removed"]
    documents = documents.drop(*added)
    found = repeated_spans(documents, sentences, min_words, folder)
    cut = found.groupBy(F.col("doc").alias("__doc")).agg(F.collect_set("hash").alias("__spans"))
    rows = documents.join(growing(cut), documents["doc_id"].cast("long") == cut["__doc"], "left").drop("__doc")
    schema = T.StructType([*documents.schema.fields, *(T.StructField(n, T.LongType()) for n in added)])
    text_at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts, total, removed = without(part.column("text"), part.column("__spans"), sentences, min_words)
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                columns[text_at] = texts
                columns += [pa.array(total), pa.array(removed)]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def without(column: pa.Array, cut: pa.Array, sentences: int, min_words: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts without their cut spans, and the sentences each had and lost."""
    found = sentence_spans(column, sentences, min_words)
    docs, doc = len(column), found["doc"]
    total = np.bincount(doc, minlength=docs)
    owner = doc[found["from"]]
    gone = ~first_in_text(found)
    listed = cut.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    sizes = np.array([len(x) if x is not None else 0 for x in (s.values for s in cut)], np.int64)
    salt = np.uint64(0xA24BAED4963EE407)
    keys = np.sort(mix(listed + np.repeat(np.arange(docs), sizes).astype(np.uint64) * salt))
    if len(keys):
        own = mix(found["hash"] + owner.astype(np.uint64) * salt)
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        gone |= keys[at] == own
    change = np.zeros(len(doc) + 1, np.int64)
    np.add.at(change, found["from"][gone], 1)
    np.add.at(change, found["to"][gone], -1)
    lost = np.cumsum(change)[:-1] > 0
    removed = np.bincount(doc[lost], minlength=docs)
    if not lost.any():
        return column, total, removed
    held, bound = found["words"], np.append(found["start"], len(found["words"].start))
    texts = column.to_pylist()
    for d in np.flatnonzero(removed):
        raw = texts[d].encode()
        base = held.offsets[d]
        pieces, at = [], 0
        for k in np.flatnonzero((doc == d) & lost) if docs < 4 else range(*np.searchsorted(doc, [d, d + 1])):
            if not lost[k]:
                continue
            start = held.start[bound[k]] - base
            next_word = bound[k + 1]
            end = held.start[next_word] - base if next_word < held.first[d + 1] else len(raw)
            pieces.append(raw[at:start])
            at = end
        pieces.append(raw[at:])
        texts[d] = b"".join(pieces).decode()
    return pa.array(texts, column.type), total, removed
