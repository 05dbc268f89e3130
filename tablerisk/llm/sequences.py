"""Token ids in Arrow stream files of fixed-size lists.

A file is an Arrow stream whose batches hold equal-length sequences (``ids``) and masks (``mask``, false
where a file's last sequence is padded). Mapped into memory, any sequence or mask is a view on
the file. A second stream beside it lists where each document starts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablerisk.llm.pieces import TOKEN_SLICE, TokenTable, kept, woven
from tablerisk.llm.store import Folder, new_folder, stored
from tablerisk.llm.text import slices

BATCH_SEQUENCES = 128
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "part long, file string, tokens long, documents long"


def sequence_schema(length: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Appends ids to one stream file, sequence after sequence."""

    def __init__(self, target: Folder, name: str, length: int, kind: pa.DataType):
        self.target, self.name, self.length, self.kind = target, name, length, kind
        self.dtype = np.dtype(kind.to_pandas_dtype())
        self.stream, self.private = target.open_new(name)
        self.writer = pa.ipc.new_stream(self.stream, sequence_schema(length, kind))
        self.pending: list[np.ndarray] = []
        self.waiting = self.tokens = 0

    def append(self, ids: np.ndarray) -> None:
        self.pending.append(ids)
        self.waiting += len(ids)
        self.tokens += len(ids)
        block = self.length * BATCH_SEQUENCES
        if self.waiting >= block:
            flat = np.concatenate(self.pending)
            whole = len(flat) // block * block
            for at in range(0, whole, block):
                self.put(flat[at : at + block], block)
            self.pending, self.waiting = [flat[whole:]], len(flat) - whole

    def put(self, flat: np.ndarray, used: int) -> None:
        mask = np.arange(len(flat)) < used
        lists = [
            pa.FixedSizeListArray.from_arrays(pa.array(flat, self.kind), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
        ]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=sequence_schema(self.length, self.kind)))

    def close(self) -> None:
        if self.waiting:
            flat = np.concatenate(self.pending)
            padded = np.zeros(-(-len(flat) // self.length) * self.length, self.dtype)
            padded[: len(flat)] = flat
            self.put(padded, len(flat))
        self.writer.close()
        self.stream.close()
        self.target.publish(self.private, self.name)


class SequenceFile:
    """Random access to the sequences and masks of one file, without copies where it is mapped."""

    def __init__(self, folder: str, name: str):
        source = Folder(folder)
        local = isinstance(source.fs, pafs.LocalFileSystem)
        handle = pa.memory_map(f"{source.path}/{name}") if local else source.open_file(name)
        self.batches = list(pa.ipc.open_stream(handle))
        self.bounds = np.cumsum([0] + [b.num_rows for b in self.batches])
        self.length = self.batches[0].schema.field("ids").type.list_size if self.batches else 0

    def __len__(self) -> int:
        return int(self.bounds[-1])

    def sequence(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view) and mask of the ``k``-th sequence."""
        b = int(np.searchsorted(self.bounds, k, "right")) - 1
        at = k - int(self.bounds[b])
        batch = self.batches[b]
        return self.flat(b)[at * self.length : (at + 1) * self.length], batch.column("mask")[at].values

    def flat(self, b: int) -> np.ndarray:
        return self.batches[b].column("ids").flatten().to_numpy(zero_copy_only=True)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from a file position on; they are a view if one batch holds them all."""
        parts = []
        while n > 0:
            b = int(np.searchsorted(self.bounds * self.length, start, "right")) - 1
            at = start - int(self.bounds[b]) * self.length
            part = self.flat(b)[at : at + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, np.uint32)])


def write_sequences(
    documents: DataFrame, tokenizer: str, keeps_space: bool, end_id: int, length: int, kind: pa.DataType, folder: str
) -> DataFrame:
    """Write all documents in doc_id order, one file per range of doc_ids; returns the manifest."""
    spark = documents.sparkSession
    dtype = np.dtype(kind.to_pandas_dtype()).newbyteorder("<")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name, target, writer, count = f"part-{part:06d}", Folder(folder), None, 0
        for batch in batches:
            for rows in slices(batch, "text", TOKEN_SLICE):
                if writer is None:
                    table = kept(("tokens", tokenizer, keeps_space), lambda: TokenTable(tokenizer, keeps_space))
                    writer = SequenceWriter(target, f"{name}.arrow", length, kind)
                    stream, private = target.open_new(f"{name}.index.arrow")
                    index = pa.ipc.new_stream(stream, INDEX)
                ends = np.full(len(rows), end_id, np.uint32), np.ones(len(rows), np.int64)
                flat, sizes = woven(table.encode(rows.column("text")), ends)
                starts = writer.tokens + np.cumsum(sizes) - sizes
                writer.append(flat.astype(dtype))
                columns = [rows.column("doc_id"), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())]
                index.write_batch(pa.RecordBatch.from_arrays(columns, schema=INDEX))
                count += len(rows)
        if writer is not None:
            writer.close()
            index.close()
            stream.close()
            target.publish(private, f"{name}.index.arrow")
            row = [[part], [name], [writer.tokens], [count]]
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, types)], ["part", "file", "tokens", "documents"]
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, MANIFEST)


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, file, n_sequences) of every document, from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, file string, n_sequences long"
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    based = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))
    files = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                held = SequenceFile(folder, f"{name}.arrow")
                with Folder(folder).open_input(f"{name}.index.arrow") as stream:
                    for part in pa.ipc.open_stream(stream):
                        spans = zip(part.column("start").to_pylist(), part.column("n_tokens").to_pylist())
                        sums = [zlib.crc32(held.tokens(s, n).astype("<u4")) for s, n in spans]
                        columns = [
                            part.column("doc_id"),
                            pc.add(part.column("start"), base),
                            part.column("n_tokens"),
                            pa.array(sums, pa.int64()),
                            pa.array([name] * len(part), pa.string()),
                            pa.array([len(held)] * len(part), pa.int64()),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    return based.select("file", "base").repartition(files).mapInArrow(run, schema)


def token_sequences(
    documents: DataFrame,
    tokenizer: str,
    keeps_space: bool = False,
    end_id: int = 1,
    length: int = 2048,
    kind: pa.DataType | None = None,
) -> DataFrame:
    """Write the ids of all documents and return what the files hold of each.

    Null text is empty and gives the end id alone; null doc_ids come first; rows that repeat a doc_id
    follow each other in order of their text; other columns are ignored. An empty table gives no
    file and no row. ``kind`` is the stored integer type and must hold every id of the tokenizer.
    """
    folder = new_folder(documents.sparkSession, "sequences")
    kind = kind or pa.uint16()
    manifest = stored(
        write_sequences(documents, tokenizer, keeps_space, end_id, length, kind, f"{folder}/files"),
        f"{folder}/manifest",
    )
    return read_documents(manifest, f"{folder}/files")
