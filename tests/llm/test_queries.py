"""The registered text queries against their SQL, and the pipeline's stages, at the smallest scale."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from factorloom.llm import catalog, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_all_are_registered():
    names = contract.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = connection.execute(catalog.ORACLE_SQL[name])
    order = [[d[0] for d in result.description].index(c) for c in columns]
    want = sorted(tuple(str(r[i]) for i in order) for r in result.fetchall())
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == want


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, step in corpus_pipeline.STAGES[1:4]:
        kept = step(spark, docs, SF)
        assert kept.columns == docs.columns and 0 < kept.count() <= before, name
    assert {"doc_id", "sequence_id", "offset"} <= set(corpus_pipeline.STAGES[4][1](spark, docs, SF).columns)


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k: k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_pipeline_content_equals_plain_steps(spark, tmp_path):
    """Every stage against a few lines of Python: what goes, which row stays, the texts, and the packed ids."""
    pick = random.Random(4)
    plain = [f"word{k}" for k in range(200)]
    rows = []
    for k in range(160):
        words = [pick.choice(plain) for _ in range(60)]
        if k % 4 == 0:
            for at in pick.sample(range(60), 8):
                words[at] = pick.choice(["nasty", "vile"])
        rows.append([k, " ".join(words)])
    clean = [r[1] for r in rows if r[0] % 4]
    near = clean[1].split()
    near[30] = "changed"
    texts = [clean[0], clean[0], " ".join(near), clean[2] + " token = 'abcd1234efgh' end", None, "", clean[0]]
    rows += [[160 + k, t] for k, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1, int(i < 160 and i % 4 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    steps = dict(corpus_pipeline.STAGES)

    kept = steps["toxicity"](spark, docs, str(tmp_path))
    net = toxicity.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    scorer = toxicity.Scorer(net)
    low = {i for i, t in rows if net.score(scorer.features(pa.array([t or ""])))[0] < 0.3}
    have = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert set(have) == low and kept.columns == docs.columns
    toxic = {i for i, _ in rows if i < 160 and i % 4 == 0}
    assert len(toxic & low) <= 2 and len(low - toxic) >= 120

    classes = {}
    for i, t in have.items():
        classes.setdefault(t or "", []).append(i)
    want = {max(ids): have[max(ids)] for ids in classes.values()}
    kept = steps["exact_dedup"](spark, kept, str(tmp_path))
    have = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert have == want

    leader = {i: i for i in have}
    for a in sorted(have):
        for b in sorted(have):
            x, y = shingles(have[a]), shingles(have[b])
            if a < b and x and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((leader[a], leader[b]))
                leader = {i: low if g == high else g for i, g in leader.items()}
    assert len(set(leader.values())) < len(have)
    kept = steps["ngram_jaccard"](spark, kept, str(tmp_path))
    have = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert have == {i: want[i] for i in set(leader.values())}

    kept = steps["secret_scan"](spark, kept, str(tmp_path))
    cleaned = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert cleaned == {i: t.replace("token = 'abcd1234efgh'", "<assign>'") if t else t for i, t in have.items()}

    library = Tokenizer.from_file(catalog.WORD_VOCABULARY)
    pieces = steps["packing"](spark, kept, str(tmp_path)).collect()
    for i, t in cleaned.items():
        mine = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        ids = np.concatenate([np.frombuffer(p["piece"], "<u4") for p in mine]).tolist()
        assert ids == [*library.encode(t or "", add_special_tokens=False).ids, 2]
    places = sorted((p["sequence_id"], p["offset"], p["length"]) for p in pieces)
    assert all(a[1] + a[2] == (b[1] if a[0] == b[0] else 4096) for a, b in zip(places, places[1:]))
