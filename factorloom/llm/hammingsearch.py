"""Exact nearest neighbours of binary codes by incremental multi-index hashing.

An embedding becomes the code of its signs.  A code is cut into segments of 16 bits, and each shard of the
index has for each segment the codes ordered by the segment's value.  A query looks up the values within
radius 0, 1, 2, ... of its own, one segment after the other.  If two codes differ in at most m * r + j - 1
bits, for m segments, they differ in at most r bits in one of the first j segments or in at most r - 1 bits in one of
the others; so once the first j segments have been searched to radius r and the others to r - 1, every code
within that distance has been verified, and a query stops as soon as its k-th verified distance is covered.

Queries and codes meet in blocks: packed shards of the index and packed chunks of distinct query codes.  Equal
codes are one entry with their k + 1 smallest ids, so a code that many rows share is one entry for all of them.
Neighbours are ordered by distance and id; a row is not its own neighbour.

Rows without id or embedding have no code and no neighbours.  Missing and undefined components count as not
positive.  Of a repeated id the smallest code counts.  With fewer than k other rows all of them are returned.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factorloom.llm.textunits import id_type
from factorloom.plans.staging import stage

SEGMENT_BITS = 16
SHARD_CODES, CHUNK_QUERIES = 1 << 16, 1 << 10
PROBES_AT_ONCE = 1 << 20


def sign_codes(rows: DataFrame, id_col: str, vector_col: str, words: int) -> DataFrame:
    """Rows (id, code): one code a row id, an array of 64-bit words."""
    def word(k: int):
        part = F.slice(F.col("vector"), 64 * k + 1, 64)
        bits = F.transform(part, lambda x, i: F.when(F.coalesce(x > 0, F.lit(False)) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    picked = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("vector"))
    picked = picked.filter(F.col("id").isNotNull() & (F.size("vector") > 0))
    return picked.select("id", F.array(*[word(k) for k in range(words)]).alias("code")).groupBy("id").agg(F.min("code").alias("code"))


@lru_cache
def ring(radius: int) -> np.ndarray:
    """All segment values with so many bits set."""
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(SEGMENT_BITS), radius)], dtype=np.uint32)


def segments_of(codes: np.ndarray) -> np.ndarray:
    """Segment values (row, segment) of codes (row, word)."""
    return np.ascontiguousarray(codes, dtype="<u8").view("<u2").reshape(len(codes), -1).astype(np.uint32)


class Shard:
    """Distinct codes of one shard with a bucket table for each segment."""

    def __init__(self, codes: np.ndarray):
        self.codes, parts = codes, segments_of(codes)
        self.order = [np.argsort(parts[:, s], kind="stable") for s in range(parts.shape[1])]
        self.edges = [np.concatenate([[0], np.cumsum(np.bincount(parts[:, s], minlength=1 << SEGMENT_BITS))]) for s in range(parts.shape[1])]

    def candidates(self, segment: int, values: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Query and code number of every code in the looked-up buckets."""
        start, count = self.edges[segment][values], self.edges[segment][values + 1] - self.edges[segment][values]
        hit = count > 0
        start, count, owners = start[hit], count[hit], owners[hit]
        inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(owners, count), self.order[segment][np.repeat(start, count) + inner]

    def search(self, queries: np.ndarray, k: int, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the codes and distances up to the distance of the k-th neighbour, ties included.

        ``weights`` is how many neighbours each code stands for.
        """
        parts, bits = segments_of(queries), 64 * queries.shape[1]
        m = parts.shape[1]
        goal = min(k, int(weights.sum()))
        # how many neighbours were verified at each distance, and the verified codes
        tally = np.zeros((len(queries), bits + 1), np.int64)
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in queries]
        active, radius = np.arange(len(queries)), 0
        reach = np.full(len(queries), bits)
        while len(active) and radius <= SEGMENT_BITS:
            for segment in range(m):
                self._probe(segment, radius, queries, parts, active, tally, found)
                covered = m * radius + segment
                within = np.cumsum(tally[active], axis=1) >= goal
                kth = np.where(within.any(1), within.argmax(1), bits + 1)
                done = kth <= covered
                reach[active[done]] = kth[done]
                active = active[~done]
                if not len(active):
                    break
            radius += 1
        results = []
        for q, parts_found in enumerate(found):
            numbers = np.concatenate([n for n, _ in parts_found]) if parts_found else np.zeros(0, np.int64)
            distances = np.concatenate([d for _, d in parts_found]) if parts_found else np.zeros(0, np.int64)
            near = distances <= reach[q]
            results.append((numbers[near], distances[near]))
        return results

    def _probe(self, segment, radius, queries, parts, active, tally, found) -> None:
        masks = ring(radius)
        step = max(1, PROBES_AT_ONCE // len(masks))
        for at in range(0, len(active), step):
            some = active[at: at + step]
            values = (parts[some, segment][:, None] ^ masks[None, :]).ravel()
            owner, number = self.candidates(segment, values, np.repeat(some, len(masks)))
            if not len(owner):
                continue
            difference = queries[owner] ^ self.codes[number]
            own = difference.view("<u2").reshape(len(owner), -1)
            each = np.bitwise_count(own)
            # verified once only: by the first segment that reaches it, at the least radius
            earlier = (each[:, :segment] <= radius).any(1) | (each[:, segment + 1:] < radius).any(1)
            owner, number, distance = owner[~earlier], number[~earlier], each[~earlier].sum(1).astype(np.int64)
            np.add.at(tally, (owner, distance), self.weights[number])
            order = np.argsort(owner, kind="stable")
            owner, number, distance = owner[order], number[order], distance[order]
            edges = np.flatnonzero(np.diff(owner, prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                found[owner[a]].append((number[a:b], distance[a:b]))


def nearest(
    rows: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Rows (id, rank, neighbor_id, distance): the k nearest other rows of every row that ``is_query`` selects."""
    spark = rows.sparkSession
    kind = id_type(rows, id_col)
    longest = rows.agg(F.max(F.size(F.col(f"`{vector_col}`")))).first()[0] or 0
    words = max(1, -(-longest // 64))
    coded = stage(sign_codes(rows, id_col, vector_col, words), "hamming-codes")
    few = W.partitionBy("code").orderBy("id")
    smallest = coded.withColumn("at", F.row_number().over(few)).filter(F.col("at") <= k + 1)
    entries = stage(smallest.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "hamming-entries")
    asked = stage(coded.filter(is_query(F.col("id"))), "hamming-queries")
    total, askers = entries.count(), asked.select("code").distinct().count()
    shards, chunks = -(-total // SHARD_CODES) or 1, -(-askers // CHUNK_QUERIES) or 1

    def packed(table: DataFrame, parts: int, name: str) -> DataFrame:
        ordered = table.withColumn(name, F.pmod(F.xxhash64("code"), F.lit(parts)).cast("int")).repartition(min(parts, 2000), name).sortWithinPartitions(name)

        def pack(batches):
            number, codes, counts = None, [], []
            for batch in batches:
                values = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, words)
                for at, part in enumerate(batch.column(0).to_pylist()):
                    if part != number:
                        if number is not None:
                            yield one(number, codes, counts)
                        number, codes, counts = part, [], []
                    codes.append(values[at])
                    counts.append(batch.column(2)[at].as_py())
            if number is not None:
                yield one(number, codes, counts)

        def one(number, codes, counts):
            return pa.record_batch(
                [pa.array([number], pa.int32()), pa.array([np.array(codes, "<i8").tobytes()]), pa.array([np.array(counts, "<i8").tobytes()])],
                [name, "codes", "counts"],
            )

        return ordered.select(name, "code", "count").mapInArrow(pack, f"{name} int, codes binary, counts binary")

    index = stage(packed(entries.withColumn("count", F.size("ids").cast("long")), shards, "shard"), "hamming-index")
    queries = packed(asked.select("code").distinct().withColumn("count", F.lit(1).cast("long")), chunks, "chunk")
    queries = stage(queries.select("chunk", F.col("codes").alias("queries")), "hamming-chunks")
    met = queries.select("chunk", "queries", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    met = met.repartition(min(shards * chunks, 2000), "shard", "chunk").join(index.select("shard", "codes", "counts"), "shard")

    def find(batches):
        for batch in batches:
            for packed_queries, packed_codes, packed_counts in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                asked_codes = np.frombuffer(packed_queries.as_buffer(), "<u8").reshape(-1, words)
                shard = Shard(np.frombuffer(packed_codes.as_buffer(), "<u8").reshape(-1, words))
                shard.weights = np.frombuffer(packed_counts.as_buffer(), "<i8")
                results = shard.search(asked_codes, k + 1, shard.weights)
                sizes = [len(n) for n, _ in results]
                numbers = np.concatenate([n for n, _ in results]) if results else np.zeros(0, np.int64)
                distances = np.concatenate([d for _, d in results]) if results else np.zeros(0, np.int64)
                lists = lambda values: pa.ListArray.from_arrays(
                    pa.array(np.arange(len(values) + 1) * words, pa.int32()), pa.array(np.ascontiguousarray(values).view("<i8").ravel(), pa.int64()))
                yield pa.record_batch(
                    [lists(np.repeat(asked_codes, sizes, axis=0)), lists(shard.codes[numbers]), pa.array(distances, pa.int32())],
                    ["query", "code", "distance"],
                )

    hits = stage(met.select("queries", "codes", "counts").mapInArrow(find, "query array<long>, code array<long>, distance int"), "hamming-hits")
    named = hits.join(entries, "code").select("query", "distance", F.explode("ids").alias("neighbor_id"))
    ranked = W.partitionBy("query").orderBy("distance", "neighbor_id")
    top = stage(named.withColumn("at", F.row_number().over(ranked)).filter(F.col("at") <= k + 1), "hamming-top")
    lists = top.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("at", "neighbor_id", "distance"))).alias("near"))
    mine = asked.join(lists.withColumnRenamed("query", "code"), "code")
    others = F.slice(F.filter("near", lambda n: n["neighbor_id"] != F.col("id")), 1, k)
    return mine.select("id", F.posexplode(others).alias("rank", "near")).select(
        F.col("id").cast(kind).alias(id_col), (F.col("rank") + 1).alias("rank"), F.col("near.neighbor_id").alias("neighbor_id"), F.col("near.distance").alias("distance")
    )
