"""Benchmark decontamination by winnowed fingerprints.

A window is ``window`` consecutive words of an item, or all of them where it has fewer.  Texts are cut into
k-grams of words; of every w consecutive k-grams the one with the least hash (the last of equal ones) is kept.
With k + w - 1 = ``window``, every shared span of so many words holds one kept k-gram at the same place on both
sides.  Documents are scanned once; a filter of fixed size thins their fingerprints, and the rest is joined with
those of the items.  The texts that pass the filter are written beside their fingerprints; each joined hit is
extended to both sides over equal words, and the spans that are long enough are the document's hits.  Items with
fewer words than the window have fingerprints of their own length, and documents are winnowed once more for each
such length in use.

Items with the same words are one class that carries all their ids, so that copies are joined once.  Nothing is
gathered but what one document matched.

Results: null and empty texts have no words and no hits, items without words match nothing, repeated rows and null
ids of documents are judged like any other.  An item id counts once however many rows have it; rows without id are
one item whose id is null.  Without documents there are no rows, without items nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from factorloom.llm.cellfilter import cells_of, may_hold
from factorloom.llm.located import PLACE, given_back, held, with_place
from factorloom.llm.textunits import bounded_batches, id_type
from factorloom.llm.wordhash import Block, mixed, word_blocks
from factorloom.plans.shipping import ship_package
from factorloom.plans.staging import stage

_STEP = np.uint64(0x94D049BB133111EB)


def gram_hashes(words: np.ndarray, k: int, salt: int) -> np.ndarray:
    """Hash of the k-gram that begins at each word but the last k - 1."""
    count = len(words) - k + 1
    total = np.full(max(count, 0), np.uint64(salt), np.uint64)
    for j in range(k):
        total = total * _STEP + words[j: j + count] if count > 0 else total
    return mixed(total)


def winnow(block: Block, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (word numbers of the block) and hashes of the fingerprints that guarantee shared spans of ``span`` words."""
    k = (span + 1) // 2
    w = span - k + 1
    hashes = gram_hashes(block.hash, k, span)
    count = len(hashes) - w + 1
    if count <= 0:
        return np.zeros(0, np.int64), hashes[:0]
    whole = block.row[:count] == block.row[span - 1: span - 1 + count]  # windows inside one row
    best, least = np.zeros(count, np.int64), hashes[:count].copy()
    for j in range(1, w):
        other = hashes[j: j + count]
        better = other <= least
        least[better], best[better] = other[better], j
    places = np.unique((np.arange(count) + best)[whole])
    return places, hashes[places]


def _firsts(block: Block) -> np.ndarray:
    """Number of each row's first word in the block."""
    return np.searchsorted(block.row, np.arange(block.rows + 1))


def item_classes(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Rows (class, words, ids): the items with words, those with the same words together."""
    kind = id_type(items, item_col)

    def cut(batches):
        for batch in batches:
            for block in word_blocks(batch.column(1)):
                firsts, words = _firsts(block), block.words()
                lists = [words[a:b] for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
                yield pa.record_batch(
                    [batch.column(0).slice(block.first, block.rows), pa.array(lists, pa.list_(pa.binary()))], ["id", "words"]
                )

    read = items.select(F.col(f"`{item_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    worded = read.mapInArrow(cut, f"id {kind}, words array<binary>").where(F.size("words") > 0)
    # collect_list leaves nulls out, so each id travels in a structure
    grouped = worded.groupBy("words").agg(F.collect_set(F.struct("id")).alias("ids"))
    key = F.sha2(F.concat_ws(" ", F.transform("words", lambda x: x.cast("string"))), 256)  # words hold no blank
    return stage(grouped.select(key.alias("class"), "words", "ids"), "leak-classes")


def _fingerprints(batches, text_at: int, spans: list[int]) -> Iterator[tuple[pa.RecordBatch, Block, int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for block in word_blocks(batch.column(text_at)):
            for span in spans:
                yield batch, block, span, *winnow(block, span)


def item_fingerprints(classes: DataFrame, window: int) -> DataFrame:
    """Rows (hash, class, span, at): the fingerprints of each class and their places in it."""

    def make(batches):
        for batch in batches:
            texts = pa.array([b" ".join(words).decode() for words in batch.column(1).to_pylist()], pa.string())
            for block in word_blocks(texts):
                firsts = _firsts(block)
                lengths = np.minimum(np.diff(firsts), window)
                for span in np.unique(lengths).tolist():
                    places, hashes = winnow(block, span)
                    mine = lengths[block.row[places]] == span
                    places, hashes = places[mine], hashes[mine]
                    rows = block.row[places]
                    yield pa.record_batch(
                        [pa.array(hashes.view(np.int64)), batch.column(0).take(pa.array(rows + block.first)),
                         pa.array(np.full(len(rows), span, np.int32)), pa.array((places - firsts[rows]).astype(np.int32))],
                        ["hash", "class", "span", "at"],
                    )

    return stage(classes.select("class", "words").mapInArrow(make, "hash long, class string, span int, at int"), "leak-fingerprints")


def extended(document: list[bytes], item: list[bytes], hits: Iterator[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Longest equal runs (start, end) of at least ``least`` words through the hits (place in document, place in item)."""
    covered: dict[int, int] = {}
    found = []
    for p, q in hits:  # ascending in p
        if covered.get(p - q, -1) > p:
            continue
        a, b = p, q
        while a > 0 and b > 0 and document[a - 1] == item[b - 1]:
            a, b = a - 1, b - 1
        c, d = p, q
        while c < len(document) and d < len(item) and document[c] == item[d]:
            c, d = c + 1, d + 1
        covered[p - q] = max(c, p + 1)
        if c - a >= least:
            found.append((a, c))
    return found


def united(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that together cover the same words, in order and apart from each other."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(
    docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Rows (id, file, row, n_words, spans, items): one for each row of ``docs``.

    ``spans`` are the hit words as (start, end) word numbers, apart and in order; ``items`` the ids of the items with
    a window in the text, without repeats.
    """
    return _contamination(with_place(docs), items, window, id_col, text_col, item_col, item_text_col)


def _contamination(
    placed: DataFrame, items: DataFrame, window: int, id_col: str, text_col: str, item_col: str, item_text_col: str
) -> DataFrame:
    if window < 1:
        raise ValueError("a window has at least one word")
    spark = placed.sparkSession
    ship_package(spark)
    bounded_batches(spark)
    classes = item_classes(items, item_col, item_text_col)
    prints = item_fingerprints(classes, window)
    spans = sorted(r[0] for r in prints.select("span").distinct().collect())  # window lengths in use: at most ``window``
    cells = spark.sparkContext.broadcast(cells_of(prints, "hash"))
    rows = placed.select(held(id_col).alias("id"), *PLACE, held(text_col).alias("text"))

    def scan(batches):
        for batch in batches:
            for block in word_blocks(batch.column(3)):
                firsts = _firsts(block)
                hits: list[list[tuple[int, int]]] = [[] for _ in range(block.rows)]
                for span in spans:
                    places, hashes = winnow(block, span)
                    passed = may_hold(cells.value, hashes)
                    owners = block.row[places[passed]]
                    for owner, place, value in zip(
                        owners.tolist(), (places[passed] - firsts[owners]).tolist(), hashes[passed].view(np.int64).tolist(), strict=True
                    ):
                        hits[owner].append((value, place))
                kind = pa.list_(pa.struct([("hash", pa.int64()), ("p", pa.int32())]))
                yield pa.record_batch(
                    [*(batch.column(i).slice(block.first, block.rows) for i in range(3)), pa.array(np.diff(firsts), pa.int64()),
                     pa.array([[{"hash": h, "p": p} for h, p in one] for one in hits], kind),
                     batch.column(3).take(pa.array([block.first + k if one else None for k, one in enumerate(hits)], pa.int64()))],
                    ["id", *PLACE, "n_words", "hits", "text"],
                )

    kind = id_type(rows, "id")
    shape = f"id {kind}, {PLACE[0]} string, {PLACE[1]} long, n_words long, hits array<struct<hash:long,p:int>>, text string"
    scanned = stage(rows.mapInArrow(scan, shape), "leak-scanned")
    hits = scanned.select(*PLACE, F.inline("hits"))
    matched = hits.join(prints, "hash").groupBy(*PLACE, "class", "span").agg(F.collect_set(F.struct("p", "at")).alias("pairs"))
    matched = matched.join(classes, "class").groupBy(*PLACE).agg(
        F.collect_list(F.struct("span", "pairs", "words", "ids")).alias("matches")
    )
    matched = stage(matched, "leak-matches")
    again = scanned.where(F.col("text").isNotNull()).select(*PLACE, "text").join(matched, list(PLACE))

    def extend(batches):
        for batch in batches:
            matches = batch.column(3)
            for block in word_blocks(batch.column(2)):
                firsts, words = _firsts(block), block.words()
                spans_out, ids_out = [], []
                for k in range(block.rows):
                    document = words[firsts[k]: firsts[k + 1]]
                    runs, ids = [], {}
                    for match in matches[block.first + k].as_py():
                        pairs = sorted((x["p"], x["at"]) for x in match["pairs"])
                        found = extended(document, match["words"], iter(pairs), match["span"])
                        runs += found
                        if found:
                            ids.update({x["id"]: None for x in match["ids"]})
                    spans_out.append([{"start": a, "end": b} for a, b in united(runs)])
                    ids_out.append(list(ids))
                yield pa.record_batch(
                    [batch.column(0).slice(block.first, block.rows), batch.column(1).slice(block.first, block.rows),
                     pa.array(spans_out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                     pa.array(ids_out, pa.list_(item_kind))],
                    [*PLACE, "spans", "items"],
                )

    item_type = id_type(items, item_col)
    item_kind = to_arrow_type(items.schema[item_col].dataType)
    ends = again.select(*PLACE, "text", "matches").mapInArrow(
        extend, f"{PLACE[0]} string, {PLACE[1]} long, spans array<struct<start:long,end:long>>, items array<{item_type}>"
    )
    ends = stage(ends.where(F.size("spans") > 0), "leak-extended")
    none = F.array().cast("array<struct<start:long,end:long>>")
    return scanned.drop("hits", "text").join(ends, list(PLACE), "left").select(
        F.col("id").alias(id_col), *PLACE, "n_words", F.coalesce("spans", none).alias("spans"),
        F.coalesce("items", F.array().cast(f"array<{item_type}>")).alias("items"),
    )


def without_leaks(
    docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item, with all their columns."""
    placed = with_place(docs)
    hit = _contamination(placed, items, window, id_col, text_col, item_col, item_text_col).where(F.size("spans") > 0).select(*PLACE)
    return given_back(placed.join(hit, list(PLACE), "left_anti"))
