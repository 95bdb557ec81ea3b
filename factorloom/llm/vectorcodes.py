"""Vector code compression: product quantisation with exact integer codebooks.

A component x becomes the integer floor(scale * x), and a vector is cut into equal consecutive parts, each with a
codebook of its own.  A chunk holds some thousand vectors of one scan task.  Inside it the rows of each
part are ordered along a Hilbert curve and laid out flat in blocks; a block stores its box (least and largest
integer of each dimension) and its sums.  In a round the distances from a box to the entries give a shortlist: an
entry that is farther than the one nearest to the box's middle, wherever in the box a row lies, is nearest to no
row of the block.  A block with one entry left adds its stored sums; the rows of the others are compared with
their shortlist alone, in 64-bit integers.  A round sends counts and sums of every entry to the driver, whose number is fixed by the
codebooks, and the codebooks back.

A codebook starts as the part of the vectors with the smallest ids.  Each round assigns every row to the nearest entry
(squared distance, the lower index of equal ones) and moves each entry to floor(sum / count); unused entries stay.
A last assignment gives codes and errors.

Results: rows whose vector is null, empty or holds null, NaN or infinite components have no code.  The first
vector by id whose length can be cut fixes the length; vectors of other lengths have no code either.  Repeated
ids are coded each and seed in the order of their components, null ids come last.  With fewer vectors than
entries the codebooks are as short.  Integers are held within +-2^((60 - bits) / 2), where bits are those of the
length (+-2^27 for 64 components), which keeps every distance in 64 bits; a component beyond counts as that limit.  A
sum of errors beyond 64 bits is null.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from factorloom.llm.textunits import id_type
from factorloom.plans.shipping import ship_package
from factorloom.plans.staging import stage

CHUNK_ROWS, BLOCK_ROWS = 32768, 8
#: Bits of a curve position.
CURVE_BITS = 64


@dataclass(frozen=True)
class Coded:
    codes: DataFrame
    codebooks: list[np.ndarray]  # of each part: entries x dimensions

    def codebooks_text(self) -> str:
        return ",".join(str(int(x)) for book in self.codebooks for entry in book for x in entry)

    def codebooks_digest(self) -> str:
        return hashlib.sha256(self.codebooks_text().encode()).hexdigest()


def curve_positions(points: np.ndarray) -> np.ndarray:
    """Position of each row along a Hilbert curve through the bounding box of all rows."""
    rows, dims = points.shape
    dims = min(dims, CURVE_BITS)
    bits = max(1, CURVE_BITS // dims)
    low = points[:, :dims].min(axis=0)
    reach = np.maximum(points[:, :dims].max(axis=0) - low, 1)
    x = [((points[:, i] - low[i]).astype(np.float64) / reach[i] * (2**bits - 1)).astype(np.uint64) for i in range(dims)]
    # transposed form: rotations from the top bit down, then Gray code
    level = np.uint64(1 << (bits - 1))
    while level > 1:
        below = level - np.uint64(1)
        for i in range(dims):
            high = (x[i] & level) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & below)
            x[0] = np.where(high, x[0] ^ below, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        level >>= np.uint64(1)
    for i in range(1, dims):
        x[i] = x[i] ^ x[i - 1]
    turn, level = np.zeros(rows, np.uint64), np.uint64(1 << (bits - 1))
    while level > 1:
        turn = np.where((x[dims - 1] & level) != 0, turn ^ (level - np.uint64(1)), turn)
        level >>= np.uint64(1)
    position = np.zeros(rows, np.uint64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            position = (position << np.uint64(1)) | (((x[i] ^ turn) >> np.uint64(bit)) & np.uint64(1))
    return position


@dataclass
class PartBlocks:
    """Rows of one part of a chunk in curve order, with the boxes and sums of their blocks."""

    order: np.ndarray  # row of the chunk at each flat place
    flat: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> PartBlocks:
        order = np.argsort(curve_positions(values), kind="stable").astype(np.int32)
        flat = values[order]
        firsts = np.arange(0, len(flat), BLOCK_ROWS)
        return cls(order, flat, np.minimum.reduceat(flat, firsts), np.maximum.reduceat(flat, firsts), np.add.reduceat(flat, firsts))

    def shortlists(self, book: np.ndarray) -> np.ndarray:
        """Which entries (columns) may be nearest to a row of each block.

        The lead is the entry nearest to the middle of the box.  The distance to the lead less that to another entry is
        linear in the row, so its largest value over the box is exact, and an entry that stays behind everywhere goes.
        """
        twice, reach = self.low + self.high, self.high - self.low
        norms = (book * book).sum(axis=1)
        lead = (norms[None] - twice @ book.T).argmin(axis=1)
        ahead = book[lead][:, None, :] - book[None]
        most = norms[lead][:, None] - norms[None] - np.einsum("bd,bjd->bj", twice, ahead) + np.einsum("bd,bjd->bj", reach, np.abs(ahead))
        listed = most >= 0
        listed[np.arange(len(lead)), lead] = True
        return listed

    def nearest(self, book: np.ndarray, listed: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and distance of the flat places ``some`` (ascending), each compared with its block's shortlist."""
        block = some // BLOCK_ROWS
        entry, distance = np.zeros(len(some), np.int64), np.full(len(some), np.iinfo(np.int64).max)
        for j in range(len(book)):
            mine = np.flatnonzero(listed[block, j])
            gap = self.flat[some[mine]] - book[j]
            far = np.einsum("ij,ij->i", gap, gap)
            closer = far < distance[mine]
            entry[mine[closer]], distance[mine[closer]] = j, far[closer]
        return entry, distance

    def totals(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and sums of every entry."""
        listed = self.shortlists(book)
        sizes = np.minimum(BLOCK_ROWS, len(self.flat) - np.arange(len(self.low)) * BLOCK_ROWS)
        counts, sums = np.zeros(len(book), np.int64), np.zeros_like(book)
        sole = listed.sum(axis=1) == 1
        only = listed[sole].argmax(axis=1)
        np.add.at(counts, only, sizes[sole])
        np.add.at(sums, only, self.sums[sole])
        some = np.flatnonzero(np.repeat(~sole, sizes))
        entry, _ = self.nearest(book, listed, some)
        counts += np.bincount(entry, minlength=len(book))
        np.add.at(sums, entry, self.flat[some])
        return counts, sums


def limit_of(dimensions: int) -> int:
    return 1 << ((60 - (dimensions - 1).bit_length()) // 2)


def _whole(rows: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """Rows (id, label, vector) with finite vectors."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("int")
    read = rows.select(F.col(f"`{id_col}`").alias("id"), label.alias("label"), vector.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return read.where(F.col("vector").isNotNull() & finite & (F.size("vector") > 0))


def _integers(vectors: np.ndarray, scale: int, limit: int) -> np.ndarray:
    return np.clip(np.floor(vectors * scale), -limit, limit).astype(np.int64)


def quantize(
    rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
) -> Coded:
    """Codes (id, label, code as array of entry numbers, error, label_error) of every whole vector, and the codebooks."""
    spark = rows.sparkSession
    ship_package(spark)
    whole = _whole(rows, id_col, vector_col, label_col)
    can = whole.where(F.size("vector") % parts == 0)
    first = [F.col("id").asc_nulls_last(), F.col("vector")]
    lead = can.select("id", "vector").orderBy(*first).limit(1).collect()
    kinds = f"id {id_type(whole, 'id')}, label {id_type(whole, 'label')}"
    if not lead:
        return Coded(spark.createDataFrame([], f"`{id_col}` {id_type(whole, 'id')}, label {id_type(whole, 'label')}, code array<int>, error long, label_error long"), [])
    length = len(lead[0]["vector"])
    width, limit = length // parts, limit_of(length)
    fitting = whole.where(F.size("vector") == length)
    seeds = fitting.select("id", "vector").orderBy(*first).limit(entries).collect()
    start = _integers(np.array([s["vector"] for s in seeds], float), scale, limit)
    books = [start[:, p * width: (p + 1) * width] for p in range(parts)]
    id_kind, label_kind = (to_arrow_type(whole.schema[c].dataType) for c in ("id", "label"))

    def packed(ids, labels, values):
        """One chunk: ids, labels and of every part order and boxes, flat as bytes."""
        blocks = [PartBlocks.of(values[:, p * width: (p + 1) * width]) for p in range(parts)]
        columns = [
            pa.array([pa.concat_arrays(ids)], pa.list_(id_kind)), pa.array([pa.concat_arrays(labels)], pa.list_(label_kind)),
        ] + [
            pa.array([np.stack([getattr(b, name) for b in blocks]).tobytes()], pa.binary()) for name in ("order", "flat", "low", "high", "sums")
        ]
        return pa.record_batch(columns, ["ids", "labels", "order", "flat", "low", "high", "sums"])

    def chunk(batches):
        ids, labels, values, size = [], [], [], 0
        for batch in batches:
            ids.append(batch.column(0))
            labels.append(batch.column(1))
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            values.append(_integers(flat.reshape(-1, length), scale, limit))
            size += batch.num_rows
            if size >= CHUNK_ROWS:
                yield packed(ids, labels, np.concatenate(values))
                ids, labels, values, size = [], [], [], 0
        if size:
            yield packed(ids, labels, np.concatenate(values))

    shape = f"ids array<{id_type(whole, 'id')}>, labels array<{id_type(whole, 'label')}>, order binary, flat binary, low binary, high binary, sums binary"
    spread = fitting.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    chunks = stage(spread.mapInArrow(chunk, shape), "vector-chunks", compression="zstd")

    def read(batch, at):
        columns = {n: batch.column(batch.schema.get_field_index(n))[at].as_buffer() for n in ("order", "flat", "low", "high", "sums")}
        order = np.frombuffer(columns["order"], np.int32).reshape(parts, -1)
        whole_part = {n: np.frombuffer(columns[n], np.int64).reshape(parts, -1, width) for n in ("flat", "low", "high", "sums")}
        return [PartBlocks(order[p], *(whole_part[n][p] for n in ("flat", "low", "high", "sums"))) for p in range(parts)]

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)

        def count(batches, shared=shared):
            counts, sums = np.zeros((parts, len(start)), np.int64), np.zeros((parts, len(start), width), np.int64)
            for batch in batches:
                for at in range(batch.num_rows):
                    for p, blocks in enumerate(read(batch, at)):
                        c, s = blocks.totals(shared.value[p])
                        counts[p] += c
                        sums[p] += s
            numbers = np.arange(parts * len(start), dtype=np.int32)
            listed = pa.ListArray.from_arrays(np.arange(len(numbers) + 1, dtype=np.int32) * width, pa.array(sums.ravel()))
            yield pa.record_batch([pa.array(numbers), pa.array(counts.ravel()), listed], ["entry", "n", "sums"])

        told = chunks.select("order", "flat", "low", "high", "sums").mapInArrow(count, "entry int, n long, sums array<long>")
        totals = told.where("n > 0").groupBy("entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
        moved = [book.copy() for book in books]
        for row in totals.collect():  # at most parts x entries rows
            p, j = divmod(row["entry"], len(start))
            moved[p][j] = [s // row["n"] for s in row["sums"]]
        books = moved
        shared.unpersist()

    final = spark.sparkContext.broadcast(books)

    def assign(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                ids, labels = batch.column(0)[at].values, batch.column(1)[at].values
                code, error = np.zeros((len(ids), parts), np.int32), np.zeros(len(ids), np.int64)
                for p, blocks in enumerate(read(batch, at)):
                    entry, distance = blocks.nearest(final.value[p], blocks.shortlists(final.value[p]), np.arange(len(ids)))
                    code[blocks.order, p] = entry
                    error[blocks.order] += distance
                listed = pa.ListArray.from_arrays(np.arange(len(ids) + 1, dtype=np.int32) * parts, pa.array(code.ravel()))
                yield pa.record_batch([ids, labels, listed, pa.array(error)], ["id", "label", "code", "error"])

    coded = stage(chunks.mapInArrow(assign, f"{kinds}, code array<int>, error long"), "vector-codes")
    by_label = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    joined = coded.join(stage(by_label, "vector-label-errors"), F.col("label").eqNullSafe(F.col("of_label")))
    return Coded(joined.select(F.col("id").alias(id_col), "label", "code", "error", "label_error"), books)
