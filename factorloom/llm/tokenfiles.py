"""Token ids in Arrow files of equal-length sequences, and random access to them.

Documents are ordered by id (null first; equal ids by a hash of their text) over range partitions.
Each partition becomes one file in the Arrow file format: record batches of fixed-size lists, one of
ids and one of the mask that is false behind a file's last id.  Beside it lies an index file with the
first position and the length of each document.  The files in order are one stream: a file's first
position is the sum of the files before it, kept in the manifest.  A sequence is found by arithmetic
and read without copying from a memory map.

Each attempt of a task writes a name of its own and only the names in the manifest are read, so a lost
executor or a second attempt leaves no trace.  Null and empty texts are documents of the end id alone.
An empty table gives no documents.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.libraryids import library_ids
from factorloom.llm.textunits import bounded_batches, id_type, text_rows, texts_of
from factorloom.plans.staging import stage, stage_root

#: Sequences in one record batch.
BATCH_SEQUENCES = 256


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a place; a plain path is a local one."""
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def sequence_schema(length: int, dtype: np.dtype) -> pa.Schema:
    return pa.schema([
        pa.field("ids", pa.list_(pa.field("item", pa.from_numpy_dtype(dtype), nullable=False), length), nullable=False),
        pa.field("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), length), nullable=False),
    ])


class SequenceWriter:
    """Writes a stream of ids as equal-length sequences; memory holds one record batch."""

    def __init__(self, sink, length: int, dtype: np.dtype):
        self._schema, self._length, self._dtype = sequence_schema(length, dtype), length, dtype
        self._writer = pa.ipc.new_file(sink, self._schema)
        self._held: list[np.ndarray] = []
        self._held_ids = self.written = 0

    def add(self, ids: np.ndarray) -> None:
        self._held.append(ids)
        self._held_ids += len(ids)
        self.written += len(ids)
        size = self._length * BATCH_SEQUENCES
        if self._held_ids >= size:
            joined = np.concatenate(self._held)
            whole = len(joined) // size * size
            for at in range(0, whole, size):
                self._batch(joined[at: at + size], size)
            self._held, self._held_ids = [joined[whole:]], len(joined) - whole

    def _batch(self, ids: np.ndarray, valid: int) -> None:
        mask = np.zeros(len(ids), dtype=bool)
        mask[:valid] = True
        parts = [pa.FixedSizeListArray.from_arrays(pa.array(v), type=f.type) for v, f in zip((ids, mask), self._schema, strict=True)]
        self._writer.write_batch(pa.record_batch(parts, schema=self._schema))

    def close(self) -> None:
        if self._held_ids:
            joined = np.concatenate(self._held)
            padded = np.zeros(-(-len(joined) // self._length) * self._length, dtype=self._dtype)
            padded[: len(joined)] = joined
            self._batch(padded, len(joined))
        self._writer.close()


class SequenceFile:
    """Random access to one file; arrays are views of the mapped file where it is local."""

    def __init__(self, uri: str):
        fs, path = opened(uri)
        source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self._reader = pa.ipc.open_file(source)
        self.length = self._reader.schema.field("ids").type.list_size

    def batch(self, number: int) -> pa.RecordBatch:
        return self._reader.get_batch(number)

    def sequence(self, number: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view) and mask of one sequence."""
        batch, row = self.batch(number // BATCH_SEQUENCES), number % BATCH_SEQUENCES
        at = row * self.length
        return batch.column(0).values.to_numpy()[at: at + self.length], batch.column(1).values.slice(at, self.length)

    def ids(self, start: int, count: int) -> np.ndarray:
        """Ids from a position of the file's stream on."""
        size, parts = self.length * BATCH_SEQUENCES, []
        while count:
            values = self.batch(start // size).column(0).values.to_numpy()[start % size: start % size + count]
            parts.append(values)
            start, count = start + len(values), count - len(values)
        return np.concatenate(parts) if len(parts) != 1 else parts[0]


@dataclass(frozen=True)
class TokenFiles:
    """A written stream: its folder and, in order, each file's name, first position, ids and documents."""

    spark: SparkSession
    folder: str
    files: tuple[tuple[str, int, int, int], ...]
    id_col: str
    id_ddl: str

    def documents(self) -> DataFrame:
        """Rows (id, start, n_tokens, ids_crc32) as read back from the files, one task a file."""
        folder, id_col = self.folder, self.id_col
        columns = f"`{id_col}` {self.id_ddl}, start long, n_tokens long, ids_crc32 long"
        if not self.files:
            return self.spark.createDataFrame([], columns)
        names = self.spark.createDataFrame([f[:2] for f in self.files], "file string, first long")

        def run(batches):
            for batch in batches:
                for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    sequences = SequenceFile(f"{folder}/{name}.arrow")
                    fs, path = opened(f"{folder}/{name}.index.arrow")
                    with fs.open_input_file(path) as source:
                        index = pa.ipc.open_file(source)
                        for k in range(index.num_record_batches):
                            rows = index.get_batch(k)
                            crcs = [
                                zlib.crc32(sequences.ids(a, n).astype("<u4").tobytes())
                                for a, n in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True)
                            ]
                            starts = pa.array(rows.column(1).to_numpy() + first)
                            yield pa.record_batch(
                                [rows.column(0), starts, rows.column(2), pa.array(crcs, pa.int64())],
                                [id_col, "start", "n_tokens", "ids_crc32"],
                            )

        return names.repartition(len(self.files), "file").mapInArrow(run, columns)


def write_token_files(
    docs: DataFrame, vocabulary: str, length: int = 2048, end_id: int = 2, files: int | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> TokenFiles:
    """Write the ids of all texts, each followed by ``end_id``, in ascending order of the document id."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = f"{stage_root(spark)}/token-files-{uuid.uuid4().hex}"
    count = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        coder = library_ids(vocabulary)
        end = np.array([end_id], dtype=coder.dtype)
        writer = None
        documents = 0
        for batch in batches:
            if writer is None:
                name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
                fs, path = opened(folder)
                fs.create_dir(path, recursive=True)
                sink = fs.open_output_stream(f"{path}/{name}.arrow")
                writer = SequenceWriter(sink, length, coder.dtype)
                schema = pa.schema([pa.field(id_col, batch.column(0).type), ("start", pa.int64()), ("n_tokens", pa.int64())])
                index_sink = fs.open_output_stream(f"{path}/{name}.index.arrow")
                index = pa.ipc.new_file(index_sink, schema)
            starts, counts = [], []
            for text in texts_of(batch, text_col):
                starts.append(writer.written)
                writer.add(np.concatenate([np.frombuffer(coder.encode(text), dtype=coder.dtype), end]))
                counts.append(writer.written - starts[-1])
            index.write_batch(pa.record_batch([batch.column(0), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=schema))
            documents += batch.num_rows
        if writer is not None:
            for part in (writer, sink, index, index_sink):
                part.close()
            yield pa.record_batch(
                [pa.array([TaskContext.get().partitionId()]), pa.array([name]), pa.array([writer.written]), pa.array([documents])],
                ["part", "file", "n_tokens", "n_docs"],
            )

    ordered = text_rows(docs, id_col, text_col).withColumn("tie", F.xxhash64(F.col(f"`{text_col}`")))
    ordered = ordered.repartitionByRange(count, F.col(f"`{id_col}`").asc_nulls_first(), "tie")
    ordered = ordered.sortWithinPartitions(F.col(f"`{id_col}`").asc_nulls_first(), "tie")
    manifest = stage(ordered.mapInArrow(run, "part long, file string, n_tokens long, n_docs long"), "token-manifest")
    first, listed = 0, []
    for row in sorted(manifest.collect()):  # one row for each file
        listed.append((row["file"], first, row["n_tokens"], row["n_docs"]))
        first += row["n_tokens"]
    return TokenFiles(spark, folder, tuple(listed), id_col, id_type(docs, id_col))
