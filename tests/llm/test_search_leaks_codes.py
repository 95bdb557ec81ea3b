"""Lexical search, decontamination and vector codes against brute force, odd rows included."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factorloom.llm import decontaminate, lexicalsearch, vectorcodes, wordhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, n_words string, items string, spans int, score string, rank long, item long, _at_file string, id string"
ITEMS = "item_id long, text string, ids string, class string, word string"


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def doc_rows(texts, ids=None):
    return [(ids[k] if ids else k, t, "a", "b", 3, "c", 4, 5, "d", "e") for k, t in enumerate(texts)]


def item_rows(texts, ids=None):
    return [(ids[k] if ids else k, t, "a", "b", "c") for k, t in enumerate(texts)]


def some_words(seed, count, kinds=40):
    pick = random.Random(seed)
    return [pick.choice(["été", "日本", "Ab", "x9"]) if pick.random() < 0.05 else f"w{int(pick.random() ** 2 * kinds)}" for _ in range(count)]


@pytest.mark.parametrize("most", [8, 64, 1 << 20])
def test_words_on_bytes_equal_the_expression(most):
    texts = [None, "", " ", "A-b C", "É" * 50 + " z", "x" * 300, "ab" * 40 + "," + "cd" * 40, "tail", "é", "no\x00null\x7fword", "9lives", "\U0001f600 ok"]
    found = [[] for _ in texts]
    seen = {}
    for block in wordhash.word_blocks(pa.array(texts), most):
        for row, word, value in zip(block.row.tolist(), block.words(), block.hash.tolist(), strict=True):
            found[block.first + row].append(word.decode())
            assert seen.setdefault(word, value) == value
    assert found == [words_of(t) for t in texts]
    assert len(set(seen.values())) == len(seen)


# --- decontamination -------------------------------------------------------------------------------


def plain_leaks(texts, items, window):
    windows = {}
    for item, text in items:
        ws = words_of(text)
        span = min(len(ws), window)
        for k in range(len(ws) - span + 1) if ws else ():
            windows.setdefault(tuple(ws[k: k + span]), set()).add(item)
    spans = {len(w) for w in windows}
    out = []
    for text in texts:
        ws, hit, names = words_of(text), set(), set()
        for span in spans:
            for p in range(len(ws) - span + 1):
                if found := windows.get(tuple(ws[p: p + span])):
                    hit.update(range(p, p + span))
                    names |= found
        out.append((len(ws), hit, names))
    return out


def leak_cases():
    passages = [" ".join(some_words(k, n)) for k, n in enumerate([30, 14, 10, 9, 5, 4, 1, 12])]
    items = [*passages, passages[0].upper(), None, "", " , ", "ha " * 25, passages[0]]
    texts = [None, "", "nothing shared at all"]
    for k, passage in enumerate(passages):
        ws = passage.split()
        texts.append(" ".join(["lead", *ws, "end"]))
        texts.append(" ".join([f"z{k}", *ws[2:], *ws[:-1], f"y{k}", *ws]))
    texts += ["ha " * 60, " ".join(passages[0].split()[3:13]), " ".join(passages[0].split()[3:12]), texts[3], " ".join(some_words(99, 4000))]
    return texts, items


@pytest.mark.parametrize("window", [1, 2, 10, 13])
def test_leaks_equal_brute_force(spark, window):
    texts, items = leak_cases()
    ids = [*range(len(items) - 2), None, 0]
    docs = spark.createDataFrame(doc_rows(texts, [None if k == 4 else k for k in range(len(texts))]), DOCS).repartition(3)
    found = {r["doc_id"]: r for r in decontaminate.contamination(docs, spark.createDataFrame(item_rows(items, ids), ITEMS), window).collect()}
    for k, (n, hit, names) in enumerate(plain_leaks(texts, list(zip(ids, items, strict=True)), window)):
        r = found[k if k != 4 else None]
        assert r["n_words"] == n and {x for s in r["spans"] for x in range(s["start"], s["end"])} == hit, k
        assert len(r["items"]) == len(set(r["items"])) and set(r["items"]) == names, k


def test_leak_edges(spark):
    texts, items = leak_cases()
    docs, none = spark.createDataFrame(doc_rows(texts), DOCS), spark.createDataFrame([], DOCS)
    bench, no_items = spark.createDataFrame(item_rows(items[:3]), ITEMS), spark.createDataFrame([], ITEMS)
    assert decontaminate.contamination(none, bench).count() == 0
    assert {(len(r["spans"]), len(r["items"])) for r in decontaminate.contamination(docs, no_items).collect()} == {(0, 0)}
    kept = decontaminate.without_leaks(docs, bench)
    clean = [k for k, (_, hit, _) in enumerate(plain_leaks(texts, list(enumerate(items[:3])), 10)) if not hit]
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == clean
    with pytest.raises(ValueError):
        decontaminate.contamination(docs, bench, window=0)


# --- lexical search --------------------------------------------------------------------------------


def plain_search(docs, items, k):
    counted = [(i, Counter(words_of(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n, total = len(counted), sum(size for _, _, size in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, size in counted:
            m = 75 + 25 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in words_of(text) if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return out


def search_cases():
    texts = [" ".join(some_words(k, 5 + k * 7 % 90, 200)) for k in range(120)]
    texts += [texts[5]] * 60 + [None, "", ",", "solo", "w1 " * 5000, texts[5].upper()]
    items = [" ".join(some_words(k, 12, 200)) for k in range(30)] + [texts[5], None, "", "absent term", "w1 w1 w1", "w1 w1 w1", "solo"]
    return texts, items


def as_rows(found):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()), key=str)


def test_search_equals_brute_force(spark, monkeypatch):
    texts, items = search_cases()
    ids = [None if k == 7 else k * 37 % 1000 for k in range(len(texts))]
    docs = spark.createDataFrame(doc_rows(texts, ids), DOCS).repartition(5)
    names = [*range(len(items) - 2), None, 3]  # a null and a repeated id
    bench = spark.createDataFrame(item_rows(items, names), ITEMS)
    want = sorted(plain_search(list(zip(ids, texts, strict=True)), list(zip(names, items, strict=True)), 20), key=str)
    assert as_rows(lexicalsearch.search(docs, bench, 20)) == want
    monkeypatch.setattr(lexicalsearch, "BATCH_ITEMS", 9)
    monkeypatch.setattr(lexicalsearch, "BLOCK_NUMBERS", 500)
    assert as_rows(lexicalsearch.search(docs, bench, 20)) == want


def test_search_edges(spark):
    texts, items = search_cases()
    docs, bench = spark.createDataFrame(doc_rows(texts), DOCS), spark.createDataFrame(item_rows(items), ITEMS)
    assert lexicalsearch.search(spark.createDataFrame([], DOCS), bench).count() == 0
    assert lexicalsearch.search(docs, spark.createDataFrame([], ITEMS)).count() == 0
    assert as_rows(lexicalsearch.search(docs, bench, 1)) == sorted(plain_search(list(enumerate(texts)), list(enumerate(items)), 1), key=str)


def test_held_frequencies_never_fall_short():
    tf = np.concatenate([np.arange(1, 3000), 10 ** np.arange(4, 13)])
    codes = np.searchsorted(lexicalsearch._HELD, tf)
    assert (lexicalsearch._HELD[codes] >= tf).all() and codes.max() <= 255
    for m in (75, 100, 5000):
        bound = lexicalsearch.impacts(lexicalsearch._HELD[codes], np.full(len(tf), m))
        assert all(b >= (10**9 * t) // (1000 * t + 12 * m) for b, t in zip(bound.tolist(), tf.tolist(), strict=True))


# --- vector codes ----------------------------------------------------------------------------------


def plain_codes(rows, parts, entries, rounds, scale=4096):
    kept = [(i, v, lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    can = [r for r in kept if len(r[1]) % parts == 0]
    if not can:
        return [], []
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    length = len(min(can, key=key)[1])
    kept = [(i, [math.floor(x * scale) for x in v], lab) for i, v, lab in sorted((r for r in kept if len(r[1]) == length), key=key)]
    width = length // parts
    books = [[v[p * width: (p + 1) * width] for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(v, book):
        d = [sum((a - b) ** 2 for a, b in zip(v, e, strict=True)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                mine = v[p * width: (p + 1) * width]
                groups.setdefault(nearest(mine, books[p])[0], []).append(mine)
            books[p] = [[sum(c) // len(groups[j]) for c in zip(*groups[j], strict=True)] if j in groups else e for j, e in enumerate(books[p])]
    out = []
    for i, v, lab in kept:
        each = [nearest(v[p * width: (p + 1) * width], books[p]) for p in range(parts)]
        out.append((i, lab, [e for e, _ in each], sum(d for _, d in each)))
    by_label = Counter()
    for _, lab, _, d in out:
        by_label[lab] += d
    return [(i, lab, code, d, by_label[lab]) for i, lab, code, d in out], books


SHAPE = "vec_id long, embedding array<float>, label int, code string, error string, part int"


def vector_rows(count, length, seed):
    g = np.random.default_rng(seed)
    middles = g.normal(0, 0.4, (6, length))
    return [(k, [float(np.float32(x)) for x in middles[k % 6] + g.normal(0, 0.1, length)], None if k % 7 == 0 else k % 3) for k in range(count)]


@pytest.mark.parametrize(("parts", "entries", "length", "count"), [(8, 16, 64, 300), (2, 4, 6, 700), (4, 16, 4, 9), (1, 3, 96, 200)])
def test_codes_equal_plain_quantisation(spark, monkeypatch, parts, entries, length, count):
    monkeypatch.setattr(vectorcodes, "BLOCK_ROWS", 16)
    rows = vector_rows(count, length, count)
    rows += [(rows[3][0], rows[5][1], 1), (None, rows[6][1], 2), (1000, None, 1), (1001, [], 1), (1002, [math.nan] * length, 1),
             (1003, [None] * length, 1), (1004, [math.inf] * length, 1), (1005, [0.5] * (length + parts), 1), rows[8]]
    df = spark.createDataFrame([(i, v, lab, "x", "y", 1) for i, v, lab in rows], SHAPE).repartition(3)
    coded = vectorcodes.quantize(df, parts, entries, rounds=3)
    want, books = plain_codes(rows, parts, entries, 3)
    assert [b.tolist() for b in coded.codebooks] == books
    got = [(r["vec_id"], r["label"], list(r["code"]), r["error"], r["label_error"]) for r in coded.codes.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert coded.codebooks_digest() == hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_codes_of_equal_and_missing_vectors(spark):
    same = spark.createDataFrame([(k, [0.25] * 8, 1, "x", "y", 1) for k in range(50)], SHAPE)
    found = {(tuple(r["code"]), r["error"], r["label_error"]) for r in vectorcodes.quantize(same).codes.collect()}
    assert found == {((0,) * 8, 0, 0)}
    for rows in ([], [(1, None, 1, "x", "y", 1), (2, [0.5] * 7, 1, "x", "y", 1)]):
        empty = vectorcodes.quantize(spark.createDataFrame(rows, SHAPE))
        assert empty.codes.count() == 0 and empty.codebooks == []
    huge = spark.createDataFrame([(1, [1e30] * 8, 1, "x", "y", 1), (2, [-1e30] * 8, 1, "x", "y", 1)], SHAPE)
    assert vectorcodes.quantize(huge).codes.count() == 2


def test_shortlists_hold_every_nearest_entry():
    g = np.random.default_rng(1)
    book = g.integers(-500, 500, (16, 5))
    values = np.concatenate([book[g.integers(0, 16, 900)] + g.integers(-60, 60, (900, 5)), g.integers(-500, 500, (100, 5))])
    blocks = vectorcodes.PartBlocks.of(values)
    gaps = ((blocks.flat[:, None] - book[None]) ** 2).sum(2)
    listed = blocks.shortlists(book)
    assert listed[np.arange(1000) // vectorcodes.BLOCK_ROWS, gaps.argmin(1)].all() and listed.mean() < 0.5
    assert sorted(blocks.order.tolist()) == list(range(1000))


def test_curve_visits_neighbours():
    side = np.array([(x, y) for x in range(16) for y in range(16)])
    walk = side[np.argsort(vectorcodes.curve_positions(side * 273))]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).mean() > 0.9
