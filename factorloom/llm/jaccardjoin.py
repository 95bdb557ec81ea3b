"""Self-join of documents by the Jaccard similarity of their word n-grams, as a grouped prefix join.

1. Every text becomes the set of hashes of its distinct n-grams.  Texts with the same set are one node.
2. Nodes that cannot have a partner go.  If two sets are similar enough, any prefix of a node's set under a
   common order meets the other set; ordering the n-grams of half of the hash range that stand in one node
   alone first, a node with enough of those has none.  The counts come from one shuffle of packed hashes; a
   task sends an n-gram that several of its nodes hold only once, so a hot n-gram costs one entry a task.
3. The sets that are left are ordered by a count table of fixed size (so that common n-grams come last) and
   then by hash.  Nodes with the same prefix and size are one group.
4. Groups that share an n-gram of their prefixes are candidates, filtered by size and by position; the
   members of a candidate pair are verified on their whole sets.  Only the connected components are asked
   for, so every n-gram's groups are first verified against its most central group, and then the pairs that are
   still in different components are verified in full, but for those that the triangle inequality of the
   Jaccard distance rules out.  No link between components is left untested.

n-grams are compared by 64-bit hashes of their words' bytes.  Texts without words have an empty set, link with
nothing and are their own component.  Null ids are kept: a component is named by its least id that is not
null.  Repeated rows are in one component.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.located import FILE, PLACE, ROW, given_back, held, with_place
from factorloom.llm.textunits import bounded_batches, utf8_buffer
from factorloom.plans.staging import stage

#: Bytes of text hashed at once (some 60 bytes of memory for each), and packed hashes held before a task sends them on.
CHUNK_BYTES = 1 << 20
HELD_HASHES = 2_000_000
TABLE_BITS = 18
LEADING_ROUNDS = 2
EARLY_GRAMS = 8

_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one behind the other, and each text's first word."""
    data = _LOWER[raw]
    inside = ~_WHITE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = bounds[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = inside[cuts]
    at = np.flatnonzero(inside)
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    places = np.searchsorted(at, starts)
    lengths = np.diff(np.append(places, len(at)))
    inner = np.arange(len(at)) - np.repeat(places, lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max()), _STEP))
    sums = np.add.reduceat(_BYTE_CODE[data[at]] * powers[inner], places)
    return mixed(sums + lengths.astype(np.uint64)), np.searchsorted(starts, bounds)


def shingle_sets(raw: np.ndarray, bounds: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a text of fewer words is one n-gram."""
    with np.errstate(over="ignore"):
        hashes, first = word_hashes(raw, bounds)
        grams = hashes * np.uint64(words | 1)
        if len(hashes) >= words:
            chain = mixed(hashes[: len(hashes) - words + 1] + np.uint64(words))
            for k in range(1, words):
                chain = mixed(chain * _STEP + hashes[k: len(hashes) - words + 1 + k])
            grams = chain
        sets = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= words:
                sets.append(np.unique(grams[a: b - words + 1]))
            elif b > a:
                chain = mixed(hashes[a: a + 1] + np.uint64(b - a))
                for k in range(a + 1, b):
                    chain = mixed(chain * _STEP + hashes[k: k + 1])
                sets.append(chain)
            else:
                sets.append(np.zeros(0, np.uint64))
    return sets


def sets_of(column: pa.Array, words: int):
    """Sets of a text column, hashed in chunks of bounded size."""
    raw, bounds = utf8_buffer(column)
    low = 0
    while low < len(bounds) - 1:
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + CHUNK_BYTES, side="right")) - 1)
        yield from shingle_sets(raw[bounds[low]: bounds[high]], bounds[low: high + 1] - bounds[low], words)
        low = high


def set_digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def needed_overlap(n, percent: int):
    """Least overlap of a set of n with any set that is similar enough."""
    return (percent * n + 99) // 100


def _sent(nodes: dict[bytes, np.ndarray], buckets: int):
    """What a task sends of its nodes' low hashes: packed entries by bucket, and hits inside the task."""
    keys = np.array([int.from_bytes(d[:8], "little", signed=True) for d in nodes], dtype=np.int64)
    sizes = [len(h) for h in nodes.values()]
    hashes = np.concatenate(list(nodes.values()))
    owner = np.repeat(np.arange(len(keys)), sizes)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    same = hashes[1:] == hashes[:-1]
    repeated = np.zeros(len(hashes), bool)
    repeated[1:] |= same
    repeated[:-1] |= same
    hits = np.bincount(owner[repeated], minlength=len(keys))
    again = np.zeros(len(hashes), bool)
    again[1:] = same
    kept = ~again
    hashes, owner, shared = hashes[kept], owner[kept], repeated[kept]
    entry_key = np.where(shared, 0, keys[owner])
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((entry_key, bucket))
    hashes, entry_key, bucket = hashes[order], entry_key[order], bucket[order]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    packed = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        heads = np.flatnonzero(np.diff(entry_key[a:b], prepend=entry_key[a] + 1))
        counts = np.diff(np.append(heads, b - a)).astype("<u4")
        blob = np.uint32(len(heads)).tobytes() + entry_key[a:b][heads].tobytes() + counts.tobytes() + hashes[a:b].tobytes()
        packed.append((int(bucket[a]), blob))
    return packed, [(int(k), int(h)) for k, h in zip(keys, hits, strict=True) if h]


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    count = int(np.frombuffer(blob, "<u4", 1)[0])
    keys = np.frombuffer(blob, "<i8", count, 4)
    counts = np.frombuffer(blob, "<u4", count, 4 + 8 * count)
    return np.repeat(keys, counts), np.frombuffer(blob, "<u8", -1, 4 + 12 * count)


_SENT = "bucket long, kind int, file string, row long, n int, low int, digest binary, key long, hits long, blob binary"


def _sent_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
    names = [part.split()[0] for part in _SENT.split(", ")]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _nodes_and_hits(placed: DataFrame, text_col: str, words: int) -> DataFrame:
    """Rows of two kinds: 0, a document with its set's size and digest; 1, hits of a node's low n-grams."""
    buckets = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send(batches):
        held, size = {}, 0
        for batch in batches:
            rows = []
            files, numbers = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for file, number, hashes in zip(files, numbers, sets_of(batch.column(2), words), strict=True):
                digest = set_digest(hashes)
                low = hashes[: np.searchsorted(hashes, np.uint64(1 << 63))]
                key = int.from_bytes(digest[:8], "little", signed=True)
                rows.append((key % buckets, 0, file, number, len(hashes), len(low), digest, key, None, None))
                if digest not in held and len(low):
                    held[digest] = low.copy()  # a view would keep the other half in memory
                    size += len(low)
            yield _sent_rows(rows)
            if size >= HELD_HASHES:
                yield from flush(held)
                held, size = {}, 0
        if held:
            yield from flush(held)

    def flush(held):
        packed, hits = _sent(held, buckets)
        for bucket, blob in packed:
            yield _sent_rows([(bucket, 1, None, None, None, None, None, None, None, blob)])
        if hits:
            yield _sent_rows([(k % buckets, 2, None, None, None, None, None, k, h, None) for k, h in hits])

    def count(batches):
        keys, hashes = [], []
        for batch in batches:
            kind = batch.column(1).to_numpy()
            other = batch.filter(pa.array(kind != 1))
            if other.num_rows:
                yield other
            for blob in batch.filter(pa.array(kind == 1)).column(9):
                k, h = _unpacked(blob.as_py())
                keys.append(k)
                hashes.append(h)
        if not hashes:
            return
        keys, hashes = np.concatenate(keys), np.concatenate(hashes)
        order = np.argsort(hashes, kind="stable")
        keys, hashes = keys[order], hashes[order]
        starts = np.flatnonzero(np.diff(hashes, prepend=hashes[0] + np.uint64(1)))
        lowest, highest = np.minimum.reduceat(keys, starts), np.maximum.reduceat(keys, starts)
        shared = np.zeros(len(starts), bool)
        shared |= lowest != highest
        shared |= np.logical_or.reduceat(keys == 0, starts)
        hit = np.repeat(shared, np.diff(np.append(starts, len(keys)))) & (keys != 0)
        found, counts = np.unique(keys[hit], return_counts=True)
        for at in range(0, len(found), 10_000):
            part = list(zip(found[at: at + 10_000].tolist(), counts[at: at + 10_000].tolist(), strict=True))
            yield _sent_rows([(0, 2, None, None, None, None, None, k, h, None) for k, h in part])

    texts = placed.select(*PLACE, held(text_col).alias("text"))
    sent = texts.mapInArrow(send, _SENT).repartition(buckets, "bucket")
    return stage(sent.mapInArrow(count, _SENT).drop("blob", "bucket"), "jaccard-nodes")


def _surviving_sets(placed: DataFrame, staged: DataFrame, text_col: str, words: int, percent: int) -> DataFrame:
    """Rows (digest, n, hashes) of the nodes that may have a partner."""
    hits = staged.filter("kind = 2").groupBy("key").agg(F.sum("hits").alias("hits"))
    nodes = staged.filter("kind = 0 AND n > 0").groupBy("digest", "n", "low", "key").agg(F.min(F.struct(*[
        F.col(c).alias(p) for c, p in zip(("file", "row"), PLACE, strict=True)
    ])).alias("place"))
    alone = F.col("low") - F.coalesce("hits", F.lit(0))
    may = nodes.join(hits, "key", "left").filter(alone < F.col("n") - needed_overlap_column(F.col("n"), percent) + 1)
    read = placed.select(*PLACE, held(text_col).alias("text")).join(may.select("digest", "place.*"), list(PLACE))

    def make(batches):
        for batch in batches:
            sets = list(sets_of(batch.column(1), words))
            yield pa.record_batch(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["digest", "n", "hashes"],
            )

    return stage(read.select("digest", "text").mapInArrow(make, "digest binary, n long, hashes binary"), "jaccard-sets")


def needed_overlap_column(n: Column, percent: int) -> Column:
    return F.floor((n * percent + 99) / 100)


def _count_table(sets: DataFrame) -> np.ndarray:
    """How many n-grams of the sets fall into each cell of a table of fixed size."""
    cells, blocks = 1 << TABLE_BITS, 64
    width = cells // blocks

    def tally(batches):
        table = np.zeros(cells, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                table += np.bincount(np.frombuffer(packed.as_buffer(), np.uint64) >> np.uint64(64 - TABLE_BITS), minlength=cells)
        filled = np.flatnonzero(table)
        yield packed_rows(filled, table[filled])

    def packed_rows(filled, counts):
        block = filled // width
        edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
        spans = list(zip(edges[:-1], edges[1:], strict=True))
        return pa.record_batch(
            [pa.array([int(block[a]) for a, _ in spans], pa.int32()),
             pa.array([filled[a:b].astype("<u4").tobytes() for a, b in spans], pa.binary()),
             pa.array([counts[a:b].astype("<u8").tobytes() for a, b in spans], pa.binary())],
            ["block", "cells", "counts"],
        )

    def add(batches):
        table = np.zeros(cells, np.int64)
        for batch in batches:
            for filled, counts in zip(batch.column(1), batch.column(2), strict=True):
                table[np.frombuffer(filled.as_buffer(), "<u4")] += np.frombuffer(counts.as_buffer(), "<u8").astype(np.int64)
        filled = np.flatnonzero(table)
        yield packed_rows(filled, table[filled])

    kinds = "block int, cells binary, counts binary"
    parts = sets.select("hashes").mapInArrow(tally, kinds).repartition(blocks, "block").mapInArrow(add, kinds)
    table = np.zeros(cells, np.int64)
    for row in parts.collect():  # the table, whose size is fixed
        table[np.frombuffer(row["cells"], "<u4")] = np.frombuffer(row["counts"], "<u8")
    return table


def _grouped(sets: DataFrame, percent: int) -> DataFrame:
    """Rows (digest, n, grp, prefix): each set's prefix and the group of sets with the same prefix and size."""
    table = sets.sparkSession.sparkContext.broadcast(_count_table(sets))

    def cut(batches):
        for batch in batches:
            groups, prefixes = [], []
            for packed in batch.column(2):
                hashes = np.frombuffer(packed.as_buffer(), np.uint64)
                length = len(hashes) - needed_overlap(len(hashes), percent) + 1
                order = np.lexsort((hashes, table.value[hashes >> np.uint64(64 - TABLE_BITS)]))[:length]
                prefix = hashes[order]
                groups.append(hashlib.blake2b(prefix.tobytes() + len(hashes).to_bytes(8, "little"), digest_size=16).digest())
                prefixes.append(prefix.astype(np.int64).tolist())
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(groups, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))],
                ["digest", "n", "grp", "prefix"],
            )

    return stage(sets.mapInArrow(cut, "digest binary, n long, grp binary, prefix array<long>"), "jaccard-prefixes")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes with the verdict over their whole sets: (a, b, common, linked)."""
    one = sets.select(F.col("digest").alias("a"), F.col("hashes").alias("set_a"))
    other = sets.select(F.col("digest").alias("b"), F.col("hashes").alias("set_b"))

    def test(batches):
        for batch in batches:
            common, linked = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                short, long = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(long, short)
                at[at == len(long)] = 0
                met = int((long[at] == short).sum())
                common.append(met)
                linked.append(100 * met >= percent * (len(x) + len(y) - met))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(linked)], ["a", "b", "common", "linked"])

    read = pairs.join(one, "a").join(other, "b").select("a", "b", "set_a", "set_b")
    return stage(read.mapInArrow(test, "a binary, b binary, common long, linked boolean"), "jaccard-verified")


def contracted(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, label) after the links (a, b) between nodes: the least label of each component.

    Every label goes to its least neighbour and on to that one's own choice; then the links are drawn between
    the new labels.  What is not a local least disappears each time, so the number of rounds is logarithmic.
    """
    end = labels.select(F.col("node").alias("b"), F.col("label").alias("to"))
    links = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("from")), "a").join(end, "b")
    links = stage(links.filter(F.col("from") != F.col("to")).select("from", "to").distinct(), "component-links")
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("to").alias("from"), F.col("from").alias("to")))
        least = both.groupBy("from").agg(F.least("from", F.min("to")).alias("least"))
        least = stage(least, "component-least")
        again = least.select(F.col("from").alias("least"), F.col("least").alias("next"))
        moved = stage(least.join(again, "least", "left").select("from", F.coalesce("next", "least").alias("new")), "component-moves")
        labels = stage(
            labels.join(moved.withColumnRenamed("from", "label"), "label", "left").select("node", F.coalesce("new", "label").alias("label")),
            "component-labels",
        )
        ends = moved.select(F.col("from").alias("to"), F.col("new").alias("new_to"))
        drawn = links.join(moved, "from").join(ends, "to").select(F.col("new").alias("from"), F.col("new_to").alias("to"))
        links = stage(drawn.filter(F.col("from") != F.col("to")).distinct(), "component-links")
    return labels


def _fits(percent: int, n_a: str, pos_a: str, n_b: str, pos_b: str) -> Column:
    """Size and position filter of two groups that meet in one n-gram of their prefixes."""
    a, b = F.col(n_a), F.col(n_b)
    sizes = F.least(a, b) * 100 >= F.greatest(a, b) * percent
    needed = F.ceil((a + b) * percent / (100 + percent) - 1e-9)
    return sizes & (F.least(a - F.col(pos_a), b - F.col(pos_b)) >= needed)


def _components_of_sets(sets: DataFrame, percent: int) -> DataFrame:
    """Labels (node, label) of the sets' components."""
    members = _grouped(sets, percent)
    groups = members.groupBy("grp", "n").agg(F.min("digest").alias("head"), F.count(F.lit(1)).alias("size"), F.first("prefix").alias("prefix"))
    groups = stage(groups, "jaccard-groups")
    postings = groups.select("grp", "n", "head", F.posexplode("prefix").alias("pos", "gram"))
    met = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("met")).filter("met > 1")
    postings = stage(postings.join(met, "gram"), "jaccard-postings")
    # a text that others were copied from shares more of its n-grams than the copies do
    central = postings.groupBy("grp", "head", "n").agg(F.sum("met").alias("met"))
    central = stage(central.select("grp", "head", (F.col("met") / (F.col("n") - needed_overlap_column(F.col("n"), percent) + 1)).alias("central")), "jaccard-central")
    nodes = stage(members.join(groups.select("grp", "head", "size"), "grp").select(F.col("digest").alias("node"), "grp", "head", "size"), "jaccard-members")
    labels = nodes.select("node", F.col("node").alias("label"))
    inside = nodes.filter((F.col("size") > 1) & (F.col("node") != F.col("head"))).select(F.col("node").alias("a"), F.col("head").alias("b"))
    tested = None
    for number in range(LEADING_ROUNDS):
        may_lead = central if tested is None else central.join(tested.select(F.col("b").alias("head")).distinct(), "head", "left_anti")
        pairs = _pairs_with_leaders(_open_postings(postings, nodes, labels), may_lead, percent)
        if number == 0:
            pairs = pairs.unionByName(inside).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        verdicts = _verified(stage(pairs, "jaccard-pairs"), sets, percent)
        labels = contracted(labels, verdicts.filter("linked").select("a", "b"))
        tested = verdicts if tested is None else tested.unionByName(verdicts)
    return contracted(labels, _verified(_open_pairs(postings, groups, nodes, labels, tested, sets, percent), sets, percent).filter("linked").select("a", "b"))


def _open_postings(postings: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings of n-grams whose groups are not yet in one component, with each group's least and largest label."""
    ranges = nodes.join(labels, "node").groupBy("grp").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    labelled = postings.join(ranges, "grp")
    state = labelled.groupBy("gram").agg(F.min("lo").alias("least"), F.max("hi").alias("most"))
    return stage(labelled.join(state.filter("least != most").select("gram"), "gram"), "jaccard-open")


def _pairs_with_leaders(opened: DataFrame, central: DataFrame, percent: int) -> DataFrame:
    """For each group one pair of heads (a, b): with the most central group of its n-grams."""
    lead = opened.join(central.select("grp", "central"), "grp").groupBy("gram").agg(
        F.max(F.struct("central", "grp", "head", "n", "pos", "lo")).alias("lead")
    )
    lead = lead.select("gram", F.col("lead.central").alias("central"), F.col("lead.grp").alias("lead_grp"), F.col("lead.head").alias("lead_head"),
                       F.col("lead.n").alias("lead_n"), F.col("lead.pos").alias("lead_pos"), F.col("lead.lo").alias("lead_lo"))
    apart = (F.col("grp") != F.col("lead_grp")) & ((F.col("lo") != F.col("lead_lo")) | (F.col("hi") != F.col("lead_lo")))
    near = opened.join(lead, "gram").filter(apart & _fits(percent, "n", "pos", "lead_n", "lead_pos"))
    return near.groupBy("head").agg(F.max(F.struct("central", "lead_head")).alias("first")).select(
        F.col("head").alias("a"), F.col("first.lead_head").alias("b")
    )


def _open_pairs(
    postings: DataFrame, groups: DataFrame, nodes: DataFrame, labels: DataFrame, tested: DataFrame, sets: DataFrame, percent: int
) -> DataFrame:
    """All candidate pairs of nodes that are still in different components and were not tested.

    In each n-gram the largest component is not paired with itself: only groups outside it look for partners.
    Two groups that share one of the first n-grams of both prefixes have met there, and do not meet again later.
    """
    early = groups.select("grp", F.slice("prefix", 1, EARLY_GRAMS).alias("early"))
    opened = _open_postings(postings, nodes, labels).join(early, "grp")
    opened = opened.withColumn("early", F.slice("early", F.lit(1), F.least("pos", F.lit(EARLY_GRAMS))))
    sizes = opened.filter("lo = hi").groupBy("gram", "lo").agg(F.count(F.lit(1)).alias("groups"))
    main = sizes.groupBy("gram").agg(F.max(F.struct("groups", "lo")).alias("main")).select("gram", F.col("main.lo").alias("main"))
    seeking = opened.join(main, "gram", "left").filter(F.col("main").isNull() | (F.col("lo") != F.col("main")) | (F.col("hi") != F.col("main")))
    seeking = seeking.select("gram", *[F.col(c).alias(f"{c}_a") for c in ("grp", "n", "pos", "lo", "hi", "early")])
    apart = (F.col("lo_a") != F.col("lo")) | (F.col("hi_a") != F.col("hi")) | (F.col("lo") != F.col("hi"))
    first = ~F.arrays_overlap("early_a", "early")
    pairs = seeking.join(opened, "gram").filter(apart & _fits(percent, "n_a", "pos_a", "n", "pos") & first)
    pairs = pairs.select(F.least("grp_a", "grp").alias("grp_a"), F.greatest("grp_a", "grp").alias("grp_b")).distinct()
    mixed_groups = nodes.filter("size > 1").join(labels, "node").groupBy("grp").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    pairs = pairs.unionByName(mixed_groups.filter("lo != hi").select(F.col("grp").alias("grp_a"), F.col("grp").alias("grp_b"))).distinct()
    ends = nodes.join(labels, "node").select("grp", "node", "label")
    spread = pairs.join(ends.select(F.col("grp").alias("grp_a"), F.col("node").alias("x"), F.col("label").alias("label_x")), "grp_a")
    spread = spread.join(ends.select(F.col("grp").alias("grp_b"), F.col("node").alias("y"), F.col("label").alias("label_y")), "grp_b")
    spread = spread.filter(F.col("label_x") != F.col("label_y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    spread = stage(spread, "jaccard-open-pairs")
    done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    spread = spread.join(done, ["a", "b"], "left_anti")
    # |d(a, p) - d(b, p)| is at most d(a, b), so a pair with a larger difference at any p is not linked
    size = sets.select("digest", "n")
    distance = tested.join(size.withColumnsRenamed({"digest": "a", "n": "n_a"}), "a").join(size.withColumnsRenamed({"digest": "b", "n": "n_b"}), "b")
    distance = distance.withColumn("far", 1 - F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common")))
    from_a = distance.select("a", F.col("b").alias("pivot"), F.col("far").alias("far_a"))
    from_b = distance.select(F.col("a").alias("b"), F.col("b").alias("pivot"), F.col("far").alias("far_b"))
    ruled_out = spread.join(from_a, "a").join(from_b, ["b", "pivot"]).filter(F.abs(F.col("far_a") - F.col("far_b")) > 1 - percent / 100 + 1e-9)
    return stage(spread.join(ruled_out.select("a", "b").distinct(), ["a", "b"], "left_anti"), "jaccard-pairs")


def components(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows (id, place, n_shingles, component_id, leads): one for each row of ``docs``.

    ``leads`` marks one row of each component: the first by place among those with the component's id.
    """
    return _components(with_place(docs), words, percent, id_col, text_col)


def _components(placed: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    bounded_batches(placed.sparkSession)
    staged = _nodes_and_hits(placed, text_col, words)
    labels = _components_of_sets(_surviving_sets(placed, staged, text_col, words, percent), percent)
    rows = staged.filter("kind = 0").select(F.col("file").alias(FILE), F.col("row").alias(ROW), "n", "digest")
    ids = placed.select(*PLACE, held(id_col).alias("id"))
    rows = rows.join(ids, list(PLACE))
    alone = F.concat_ws("#", FILE, F.col(ROW).cast("string")).cast("binary")
    key = F.when(F.col("n") == 0, alone).otherwise(F.coalesce("label", "digest"))
    rows = stage(rows.join(labels.withColumnRenamed("node", "digest"), "digest", "left").select("id", *PLACE, "n", key.alias("key")), "jaccard-rows")
    named = rows.groupBy("key").agg(F.min("id").alias("component_id"))
    named = rows.join(named, "key")
    first = named.filter(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("key").agg(F.min(F.struct(*PLACE)).alias("first"))
    return named.join(first, "key").select(
        F.col("id").alias(id_col), *PLACE, F.col("n").cast("long").alias("n_shingles"),
        "component_id", (F.struct(*PLACE) == F.col("first")).alias("leads"),
    )


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that lead their component, with all their columns."""
    placed = with_place(docs)
    leads = _components(placed, words, percent, id_col, text_col).filter("leads").select(*PLACE)
    return given_back(placed.join(leads, list(PLACE), "left_semi"))
