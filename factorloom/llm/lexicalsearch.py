"""Ranked lexical search with hashed max-sketches.

A document's sketch has 2^14 coordinates.  A term falls on the coordinate that its hash names, and a coordinate holds
the largest frequency of the terms on it, rounded up to a byte; only filled coordinates are stored.  A term's
impact grows with its frequency, so the impact of the held frequency, with the query term's weight,
is never below that of the term itself, and the sum over a query's terms bounds the document's score from above.
The index holds each text beside its sketch, in a column that only scoring reads.

Queries are looked up in batches of bounded size: the impacts of a block of documents times the weights of
the batch gives all bounds.  The documents with the k highest bounds of a query are scored exactly; the k-th of
these scores is the threshold, and every document whose bound reaches it is scored, by descending bound, while a
task's own k-th score raises the threshold further.  The documents left out cannot be among the k best.

Terms are told apart by their bytes wherever frequencies are counted; hashes only choose coordinates and thin what
leaves a scan.

Results: null and empty texts and texts without terms are no documents in any count and are never found.  Every row
of ``items`` is a query of its own, also with a repeated or null id; one without terms finds nothing.  Repeated document
ids are ranked each, of equal scores the smaller id goes first and null ids last.  Empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from factorloom.llm.cellfilter import cells_of, may_hold
from factorloom.llm.located import PLACE, held, with_place
from factorloom.llm.textunits import bounded_batches, id_type
from factorloom.llm.wordhash import Block, word_blocks
from factorloom.plans.shipping import ship_package
from factorloom.plans.staging import stage

COORDINATE_BITS = 14
BATCH_ITEMS = 256
#: Numbers of one block of impacts: bounds the memory of a lookup.
BLOCK_NUMBERS = 1 << 22
_BLOCK_ROWS = 1 << 15

#: Frequency that each byte of a sketch stands for: exact up to 127, then eight steps a doubling, the last without bound.
_HELD = np.array([*range(128), *[int(np.ceil(128 * 2 ** (s / 8))) for s in range(1, 128)], np.iinfo(np.int64).max], np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Impact of a term by its frequency and its document's length measure; one without bound is below a million."""
    bounded = np.minimum(tf, _HELD[254])
    return np.where(tf > _HELD[254], 1_000_000, (1_000_000_000 * bounded) // (1000 * bounded + 12 * m))


def length_measures(terms: list[int], documents: int, total: int) -> np.ndarray:
    return np.array([75 + 25 * n * documents // total for n in terms], np.int64)


def build_index(placed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, file, row, n, coordinates, frequencies, text): the sketch of every document with a term, and its text."""
    rows = placed.select(held(id_col).alias("id"), *PLACE, held(text_col).alias("text"))

    def fold(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, _BLOCK_ROWS):
                batch = whole.slice(at, _BLOCK_ROWS)
                for block in word_blocks(batch.column(3)):
                    yield sketched(batch, block)

    def sketched(batch, block):
        bits = np.uint64(64 - 16)
        keys = np.sort((block.row.astype(np.uint64) << bits) | (block.hash >> np.uint64(16)))
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
        tf = np.diff(first, append=len(keys))
        cells = keys[first] >> np.uint64(48 - COORDINATE_BITS)
        start = np.flatnonzero(np.diff(cells, prepend=~cells[:1]) != 0)
        most = np.maximum.reduceat(tf, start) if len(start) else tf[:0]
        cells = cells[start]
        coordinates = (cells & np.uint64((1 << COORDINATE_BITS) - 1)).astype("<u2")
        codes = np.searchsorted(_HELD, most).astype(np.uint8)
        edges = np.searchsorted(cells >> np.uint64(COORDINATE_BITS), np.arange(block.rows + 1, dtype=np.uint64))
        spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        return pa.record_batch(
            [*(batch.column(i).slice(block.first, block.rows) for i in range(3)),
             pa.array(np.bincount(block.row, minlength=block.rows), pa.int64()),
             pa.array([coordinates[a:b].tobytes() for a, b in spans], pa.binary()),
             pa.array([codes[a:b].tobytes() for a, b in spans], pa.binary()), batch.column(3).slice(block.first, block.rows)],
            ["id", *PLACE, "n", "coordinates", "frequencies", "text"],
        )

    shape = f"id {id_type(rows, 'id')}, {PLACE[0]} string, {PLACE[1]} long, n long, coordinates binary, frequencies binary, text string"
    return stage(rows.mapInArrow(fold, shape).where("n > 0"), "lexical-index", compression="zstd")


def _same_words(block: Block, picked: np.ndarray, like: np.ndarray) -> bool:
    """Whether each picked word has the bytes of the word it is taken for."""
    size = block.end[picked] - block.start[picked]
    if not np.array_equal(size, block.end[like] - block.start[like]):
        return False
    a, b = block.start[picked], block.start[like]
    differ = a != b
    a, b, size, at = a[differ], b[differ], size[differ], 0
    while len(size):
        if not np.array_equal(block.raw[a + at], block.raw[b + at]):
            return False
        at += 1
        longer = size > at
        a, b, size = a[longer], b[longer], size[longer]
    return True


def document_frequencies(placed: DataFrame, terms: DataFrame, text_col: str) -> DataFrame:
    """Rows (term, df) of the given terms (term, hash): how many documents hold each."""
    cells = placed.sparkSession.sparkContext.broadcast(cells_of(terms, "hash"))

    def tally(batches):
        for batch in batches:
            counts: Counter[bytes] = Counter()
            for block in word_blocks(batch.column(0)):
                picked = np.flatnonzero(may_hold(cells.value, block.hash))
                kinds, first, kind = np.unique(block.hash[picked], return_index=True, return_inverse=True)
                if _same_words(block, picked, picked[first][kind]):
                    pairs = np.unique(block.row[picked].astype(np.int64) * max(len(kinds), 1) + kind)
                    for word, n in zip(block.words(picked[first]), np.bincount(pairs % max(len(kinds), 1), minlength=len(kinds)).tolist(), strict=True):
                        counts[word] += n
                else:
                    counts.update(word for _, word in set(zip(block.row[picked].tolist(), block.words(picked), strict=True)))
            yield pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["term", "df"])

    found = placed.select(held(text_col).alias("text")).mapInArrow(tally, "term binary, df long")
    return found.groupBy("term").agg(F.sum("df").alias("df")).join(terms.select("term"), "term")


def query_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Rows (item, id, term, hash, times): the terms of every item, numbered by its row."""
    kind = id_type(items, item_col)
    numbered = items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{item_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def cut(batches):
        for batch in batches:
            for block in word_blocks(batch.column(2)):
                words = block.words()
                times = Counter(zip(block.row.tolist(), words, block.hash.view(np.int64).tolist(), strict=True))
                keys = list(times)
                at = pa.array([block.first + k[0] for k in keys], pa.int64())
                yield pa.record_batch(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array([k[1] for k in keys], pa.binary()),
                     pa.array([k[2] for k in keys], pa.int64()), pa.array(list(times.values()), pa.int64())],
                    ["item", "id", "term", "hash", "times"],
                )

    return stage(numbered.mapInArrow(cut, f"item long, id {kind}, term binary, hash long, times long"), "lexical-queries")


@dataclass
class Batch:
    """Queries of one batch in the form that tasks use."""

    items: list[int]
    columns: np.ndarray  # column of each coordinate, -1 without query term
    weights: np.ndarray  # columns x queries
    terms: dict[bytes, list[tuple[int, int]]]  # of each term the queries and weight times repeats
    documents: int
    total: int

    @classmethod
    def of(cls, rows, documents: int, total: int) -> Batch:
        items = sorted({r["item"] for r in rows})
        number = {item: q for q, item in enumerate(items)}
        at = {r["term"]: (r["hash"] % (1 << 64)) >> (64 - COORDINATE_BITS) for r in rows}
        columns = np.full(1 << COORDINATE_BITS, -1, np.int64)
        used = np.unique(list(at.values()))
        columns[used] = np.arange(len(used))
        weights, terms = np.zeros((len(used), len(items))), {}
        for r in rows:
            q, value = number[r["item"]], r["w"] * r["times"]
            weights[columns[at[r["term"]]], q] += value
            terms.setdefault(bytes(r["term"]), []).append((q, value))
        return cls(items, columns, weights, terms, documents, total)

    def bounds(self, batch: pa.RecordBatch, first: int) -> np.ndarray:
        """Upper bounds (documents x queries) from the columns n, coordinates, frequencies that begin at ``first``."""
        m = length_measures(batch.column(first).to_pylist(), self.documents, self.total)
        sizes = np.array([len(x) for x in batch.column(first + 2).to_pylist()], np.int64)
        coordinates = np.frombuffer(b"".join(batch.column(first + 1).to_pylist()), "<u2")
        codes = np.frombuffer(b"".join(batch.column(first + 2).to_pylist()), np.uint8)
        row = np.repeat(np.arange(len(m)), sizes)
        column = self.columns[coordinates]
        asked = np.flatnonzero(column >= 0)
        row, column = row[asked], column[asked]
        value = impacts(_HELD[codes[asked]], m[row]).astype(np.float64)
        edges = np.searchsorted(row, np.arange(len(m) + 1))
        out = np.empty((len(m), len(self.items)))
        step = max(1, BLOCK_NUMBERS // max(1, len(self.weights)))
        for at in range(0, len(m), step):
            end = min(at + step, len(m))
            a, b = edges[at], edges[end]
            block = np.zeros((end - at, len(self.weights)))
            block[row[a:b] - at, column[a:b]] = value[a:b]
            out[at:end] = block @ self.weights
        return np.ceil(out * (1 + 1e-12))  # sums beyond 2^53 are rounded up

    def score(self, words: list[bytes], m: int) -> dict[int, int]:
        """Exact scores of one document for the queries that share a term with it."""
        found: dict[int, int] = {}
        for word, tf in Counter(w for w in words if w in self.terms).items():
            impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m)
            for q, value in self.terms[word]:
                found[q] = found.get(q, 0) + value * impact
        return found


def _highest_bounds(index: DataFrame, shared, k: int) -> DataFrame:
    """Rows (item, file, row, bound): the k highest bounds of each query, chosen first in every task."""

    def look(batches):
        queries = shared.value
        best: list[list[tuple[float, str, int]]] = [[] for _ in queries.items]
        for batch in batches:
            bounds = queries.bounds(batch, 2)
            files, rows = batch.column(0), batch.column(1)
            for q, mine in enumerate(best):
                column = bounds[:, q]
                floor = mine[0][0] if len(mine) == k else 0
                some = np.flatnonzero(column > floor)
                if len(some) > k:
                    some = some[np.argpartition(-column[some], k - 1)[:k]]
                for i in some.tolist():
                    heapq.heappush(mine, (column[i], files[i].as_py(), rows[i].as_py()))
                    if len(mine) > k:
                        heapq.heappop(mine)
        rows = [(queries.items[q], f, r, b) for q, mine in enumerate(best) for b, f, r in mine]
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.float64()), strict=True)], ["item", *PLACE, "bound"])

    found = index.select(*PLACE, "n", "coordinates", "frequencies").mapInArrow(look, f"item long, {PLACE[0]} string, {PLACE[1]} long, bound double")
    ordered = W.partitionBy("item").orderBy(F.desc("bound"), *PLACE)
    return found.withColumn("at", F.row_number().over(ordered)).where(F.col("at") <= k).drop("at")


class Best:
    """The k best documents of every query that a task has scored."""

    def __init__(self, queries: Batch, floor: np.ndarray, k: int):
        self.queries, self.floor, self.k = queries, floor.copy(), k
        self.found: list[list[tuple]] = [[] for _ in queries.items]

    def score(self, ids: list, texts: pa.Array, asked: list[list[tuple[int, float]]]) -> None:
        """Scores documents in the given order for the queries (number, bound) asked of each."""
        for block in word_blocks(texts):
            words, edges = block.words(), np.searchsorted(block.row, np.arange(block.rows + 1))
            for d in range(block.rows):
                wanted = [q for q, bound in asked[block.first + d] if bound >= self.floor[q]]
                if wanted:
                    self._offer(ids[block.first + d], words[edges[d]: edges[d + 1]], wanted)

    def _offer(self, doc, words: list[bytes], wanted: list[int]) -> None:
        m = int(length_measures([len(words)], self.queries.documents, self.queries.total)[0])
        scores = self.queries.score(words, m)
        for q in wanted:
            score, mine = scores.get(q, 0), self.found[q]
            if score > 0 and score >= self.floor[q]:
                mine.append((score, doc))
                if len(mine) >= 2 * self.k:  # equal scores with larger ids go
                    mine[:] = sorted(mine, key=_by_rank)[: self.k]
                    self.floor[q] = max(self.floor[q], mine[-1][0])

    def rows(self, id_arrow: pa.DataType):
        rows = [(self.queries.items[q], doc, score) for q, mine in enumerate(self.found) for score, doc in sorted(mine, key=_by_rank)[: self.k]]
        if rows:
            kinds = (pa.int64(), id_arrow, pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["item", "id", "score"])


def _score_pairs(index: DataFrame, pairs: DataFrame, shared, k: int) -> DataFrame:
    """Rows (item, id, score): exact scores of the documents with the highest bounds, at most k a query."""
    # at most BATCH_ITEMS * k rows, whatever the number of documents
    texts = index.select(*PLACE, "id", "text").join(F.broadcast(pairs), list(PLACE)).select("id", "text", "queries")
    id_arrow = to_arrow_type(texts.schema["id"].dataType)

    def run(batches):
        best = Best(shared.value, np.zeros(len(shared.value.items)), k)
        for batch in batches:
            asked = [[(q, np.inf) for q in qs] for qs in batch.column(2).to_pylist()]
            best.score(batch.column(0).to_pylist(), batch.column(1), asked)
        yield from best.rows(id_arrow)

    return texts.mapInArrow(run, f"item long, id {id_type(texts, 'id')}, score long")


def _score_reaching(index: DataFrame, shared, thresholds, k: int) -> DataFrame:
    """Rows (item, id, score): the k best of every task among the documents whose bound reaches a query's threshold."""
    rows = index.select("id", "text", "n", "coordinates", "frequencies")
    id_arrow = to_arrow_type(rows.schema["id"].dataType)

    def run(batches):
        best = Best(shared.value, thresholds.value, k)
        for batch in batches:
            bounds = shared.value.bounds(batch, 2)
            row, query = np.nonzero((bounds >= best.floor) & (bounds > 0))
            top = bounds.max(axis=1, initial=0)
            candidates = np.unique(row)
            candidates = candidates[np.argsort(-top[candidates], kind="stable")]
            edges = np.searchsorted(row, np.arange(len(bounds) + 1))
            asked = [list(zip(query[edges[d]: edges[d + 1]].tolist(), bounds[d, query[edges[d]: edges[d + 1]]].tolist(), strict=True)) for d in candidates.tolist()]
            at = pa.array(candidates)
            best.score(batch.column(0).take(at).to_pylist(), batch.column(1).take(at), asked)
        yield from best.rows(id_arrow)

    return rows.mapInArrow(run, f"item long, id {id_type(rows, 'id')}, score long")


def _by_rank(found: tuple) -> tuple:
    return (-found[0], found[1] is None, found[1] if found[1] is not None else 0)


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Rows (item id, rank, id, score): the k documents of highest score above 0 for every row of ``items``."""
    spark = docs.sparkSession
    ship_package(spark)
    bounded_batches(spark)
    placed = with_place(docs)
    asked = query_terms(items, item_col, item_text_col)
    index = build_index(placed, id_col, text_col)
    documents, total = index.agg(F.count(F.lit(1)), F.sum("n")).first()
    n_items = asked.select("item").distinct().count()
    ranked = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    kind, item_kind = id_type(docs, id_col), id_type(items, item_col)
    out = None
    if documents and n_items:
        frequencies = document_frequencies(placed, asked.select("term", "hash").distinct(), text_col)
        weight = F.floor(1000 * F.ln((F.lit(2.0 * documents) + 2) / (2 * F.col("df") + 1))).cast("long")
        weighted = stage(asked.join(frequencies.select("term", weight.alias("w")), "term"), "lexical-weights")
        names = asked.select("item", "id").distinct()
        for number in range(-(-n_items // BATCH_ITEMS)):
            part = weighted.where(F.pmod(F.xxhash64("item"), F.lit(-(-n_items // BATCH_ITEMS))) == number)
            batch = Batch.of(part.select("item", "term", "hash", "times", "w").collect(), documents, total)  # a bounded number of queries
            if not batch.items:
                continue
            shared = spark.sparkContext.broadcast(batch)
            place = {item: q for q, item in enumerate(batch.items)}
            number_of = F.expr("array_position(queries_of, item)") - 1
            top = stage(_highest_bounds(index, shared, k), "lexical-first")
            listed = F.array(*[F.lit(i) for i in batch.items])
            pairs = top.withColumn("queries_of", listed).groupBy(*PLACE).agg(F.collect_list(number_of.cast("int")).alias("queries"))
            first = _score_pairs(index, pairs, shared, k)
            order = W.partitionBy("item").orderBy(F.desc("score"))
            kth = first.withColumn("at", F.row_number().over(order)).where(F.col("at") == k).select("item", "score")
            floor = np.zeros(len(batch.items))
            for row in kth.collect():  # one row for each query of the batch
                floor[place[row["item"]]] = row["score"]
            thresholds = spark.sparkContext.broadcast(floor)
            scored = _score_reaching(index, shared, thresholds, k).withColumnRenamed("id", "doc")
            best = scored.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            found = stage(best, "lexical-best").join(names, "item")
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"`{item_col}` {item_kind}, rank int, `{id_col}` {kind}, score long")
    return out.select(F.col("id").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(id_col), "score")
