"""Packing documents into equal-length training sequences by concatenating and cutting.

First pass: every scan partition encodes its documents once, writes their ids and gives its total.  The
prefix sums of the totals are the global offsets of the partitions.  Second pass: each document's global
position is known, so it is cut at multiples of the sequence length, and each piece becomes one boundary
record.  Nothing is shuffled, no group is gathered, and only the last sequence of all has padding.

Null and empty texts are documents of the end id alone.  Repeated rows and null ids are packed like any
other; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from factorloom.llm.libraryids import library_ids
from factorloom.llm.textunits import bounded_batches, id_type, text_rows, texts_of
from factorloom.plans.staging import stage


def pack_documents(
    docs: DataFrame, vocabulary: str, length: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows (id, start, length, ids_crc32, doc_tokens, sequence_id, offset, piece): one for each piece.

    ``start`` is the piece's first id in its document, ``offset`` its place in the sequence and ``piece``
    its ids as little-endian unsigned 32-bit integers.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = id_type(docs, id_col)

    def encode(batches):
        coder = library_ids(vocabulary)
        end = np.array([end_id], dtype=coder.dtype).tobytes()
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [coder.encode(text) + end for text in texts_of(batch, text_col)]
            counts = np.array([len(i) // coder.dtype.itemsize for i in ids], dtype=np.int64)
            firsts = total + np.cumsum(counts) - counts
            total += int(counts.sum())
            yield pa.record_batch(
                [batch.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(firsts), pa.array(counts), pa.array(ids, pa.binary())],
                [id_col, "part", "first", "doc_tokens", "ids"],
            )

    encoded = text_rows(docs, id_col, text_col).mapInArrow(encode, f"`{id_col}` {kind}, part int, first long, doc_tokens long, ids binary")
    encoded = stage(encoded, "packing-ids", compression="zstd")
    first, offsets = 0, {}
    for row in sorted(encoded.groupBy("part").sum("doc_tokens").collect()):  # one row for each scan partition
        offsets[row[0]] = first
        first += row[1]
    bases = spark.sparkContext.broadcast(offsets)

    def cut(batches):
        coder = library_ids(vocabulary)
        for batch in batches:
            rows = {name: [] for name in ("at", "start", "length", "crc", "total", "sequence", "offset", "piece")}
            parts, firsts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for at, packed in enumerate(batch.column(4)):
                ids = np.frombuffer(packed.as_buffer(), dtype=coder.dtype).astype("<u4")
                position, start = bases.value[parts[at]] + firsts[at], 0
                while start < len(ids):
                    sequence, offset = divmod(position + start, length)
                    taken = min(length - offset, len(ids) - start)
                    piece = ids[start: start + taken].tobytes()
                    for name, value in zip(rows, (at, start, taken, zlib.crc32(piece), len(ids), sequence, offset, piece), strict=True):
                        rows[name].append(value)
                    start += taken
            longs = [pa.array(rows[n], pa.int64()) for n in ("start", "length", "crc", "total", "sequence", "offset")]
            yield pa.record_batch(
                [batch.column(0).take(pa.array(rows["at"], pa.int64())), *longs, pa.array(rows["piece"], pa.binary())],
                [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "piece"],
            )

    return encoded.mapInArrow(
        cut,
        f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, piece binary",
    )
