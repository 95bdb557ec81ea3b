"""Registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import (
    bpe, chatformat, decontaminate, exactdedup, hammingsearch, jaccardjoin, lexicalsearch, packing, secretscan, tokencounts, tokenfiles, toxicity, vectorcodes,
)
from factorloom.plans.shipping import ship_package

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")), threshold=0.3)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.scan(_table(spark, sf_dir, "documents"))
    base = tuple(r.kind for r in secretscan.BASE_RULES)
    counts = [F.size(secretscan.of_kinds(F.col("found"), (k,))).cast("long").alias(f"n_{k}") for k in base]
    own = secretscan.spans_text(secretscan.of_kinds(F.col("found"), base))
    return found.select(
        "doc_id", *counts, F.sha2(own.cast("binary"), 256).alias("base_sha256"), secretscan.spans_text(F.col("found")).alias("spans")
    )


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.write_token_files(_table(spark, sf_dir, "documents"), BYTE_VOCABULARY).documents()


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(_table(spark, sf_dir, "documents"), BYTE_VOCABULARY, budget=512)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), WORD_VOCABULARY).drop("piece")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccardjoin.components(_table(spark, sf_dir, "documents"), words=5, percent=80)
    return found.select("doc_id", "n_shingles", "component_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = exactdedup.duplicate_classes(_table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatformat.repaired(_table(spark, sf_dir, "conversations"))


def op10_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hammingsearch.nearest(_table(spark, sf_dir, "embeddings"), lambda key: key % 20 == 0, k=10)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicalsearch.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vectorcodes.quantize(_table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    digits = F.transform("code", lambda k: F.lpad(F.lower(F.hex(k)), 2, "0"))
    return coded.codes.select(
        "vec_id", F.array_join(digits, "").alias("code"), "error", "label_error", F.lit(coded.codebooks_digest()).alias("codebooks_sha256")
    )


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_bpe_round_trip, op3_secret_scan, op4_token_files, op5_token_counts, op6_packing, op7_ngram_jaccard,
    op8_exact_dedup, op9_chat_format, op10_hamming_search, op11_lexical_search, op12_decontamination,
    op13_vector_codes,
)}

# Written out once more, apart from the operator's own table: kind, expression, group of the value, its least length.
_SECRET_RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
)


def _secret_sql() -> str:
    """Positions from the lengths of the parts between and in the matches of each rule."""
    text = lambda value: "'" + value.replace("'", "''") + "'"
    matches = " UNION ALL ".join(
        f"SELECT doc_id, {text(kind)} AS kind, {n} AS rule, {least} AS least, regexp_split_to_array(t, {text(rule)}) AS cut, "
        f"regexp_extract_all(t, {text(rule)}, 0) AS hit, regexp_extract_all(t, {text(rule)}, {group}) AS val FROM d"
        for n, (kind, rule, group, least) in enumerate(_SECRET_RULES)
    )
    total = lambda part: f"coalesce(list_sum(list_transform({part}, lambda x: length(x))), 0)"
    base = "('assign', 'access', 'hex')"
    joined = lambda condition: f"coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rule) FILTER (WHERE {condition}), '')"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({matches}),
        s AS (SELECT *, unnest(range(1, len(hit) + 1)) AS i FROM m),
        p AS (SELECT doc_id, kind, rule, CAST({total('cut[1:i]')} + {total('hit[1:i-1]')} AS BIGINT) AS a, length(hit[i]) AS size FROM s WHERE length(val[i]) >= least),
        q AS (SELECT *, a + size AS b FROM p)
        SELECT d.doc_id, {counts}, sha256({joined('kind IN ' + base)}) AS base_sha256, {joined('kind IS NOT NULL')} AS spans
        FROM d LEFT JOIN q USING (doc_id) GROUP BY d.doc_id"""



def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """One table of codebooks and one of assignments for each round."""
    near = lambda k: f"""a{k} AS MATERIALIZED (  -- nearest entry of every part, ties to the lower index
        SELECT vec_id, label, part, v, min(struct_pack(d := d, e := entry)) AS best
        FROM (SELECT x.*, entry, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
              FROM x JOIN b{k} b USING (part)) GROUP BY ALL)"""  # noqa: E731
    moved = lambda k: f"""s{k} AS MATERIALIZED (
        SELECT part, best.e AS entry, place, sum(v[place]) AS total, count(*) AS n
        FROM (SELECT *, unnest(range(1, len(v) + 1)) AS place FROM a{k}) GROUP BY 1, 2, 3),
        m{k} AS (SELECT part, entry, list(CAST((total - (((total % n) + n) % n)) // n AS BIGINT) ORDER BY place) AS v FROM s{k} GROUP BY 1, 2),
        b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m USING (part, entry))"""  # noqa: E731
    steps = ", ".join(near(k) + ", " + moved(k) for k in range(rounds)) + ", " + near(rounds)
    return f"""WITH kept AS (
        SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor(4096 * CAST(e AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0),
        x AS MATERIALIZED (
        SELECT vec_id, label, part, w[part * (len(w) // {parts}) + 1:(part + 1) * (len(w) // {parts})] AS v
        FROM (SELECT *, unnest(range(0, {parts})) AS part FROM kept)),
        b0 AS MATERIALIZED (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, v FROM x
               WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries})),
        {steps},
        books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}),
        r AS (SELECT vec_id, label, string_agg(printf('%02x', CAST(best.e AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error
              FROM a{rounds} GROUP BY 1, 2)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, books"""


_WORDS_SQL = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

ORACLE_SQL = {
    "op3_secret_scan": _secret_sql(),
    "op7_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
            FROM documents),
        g AS (
            SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 5 THEN ws[i:i + 4] ELSE ws END AS gram
            FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (SELECT doc_id AS node, doc_id AS met FROM documents UNION SELECT node, b FROM reach JOIN both_ways ON met = a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(met) AS component_id FROM reach GROUP BY 1) c ON c.node = d.doc_id""",
    "op8_exact_dedup": """
        WITH rows AS (SELECT doc_id, coalesce(text, '') AS content FROM documents),
        classes AS (SELECT content, max(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY content)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256
        FROM rows JOIN classes USING (content)""",
    "op11_lexical_search": rf"""
        WITH d AS (SELECT doc_id, unnest({_WORDS_SQL}) AS term FROM documents),
        q AS (SELECT item_id, unnest({_WORDS_SQL}) AS term FROM benchmark),
        t AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY 1, 2),
        s AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM t GROUP BY 1),
        c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM s),
        w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, c GROUP BY term, docs),
        m AS (SELECT doc_id, 75 + (25 * n * docs) // total AS m FROM s, c),
        r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
              FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY 1, 2)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM r WHERE score > 0 QUALIFY rank <= 20""",
    "op13_vector_codes": _codes_sql(),
    "op12_decontamination": rf"""
        WITH d AS (SELECT doc_id, {_WORDS_SQL} AS ws FROM documents),
        i AS (SELECT item_id, {_WORDS_SQL} AS ws FROM benchmark),
        spans AS (SELECT DISTINCT least(len(ws), 10) AS span FROM i WHERE len(ws) > 0),
        w AS (SELECT DISTINCT item_id, least(len(ws), 10) AS span, ws[k:k + least(len(ws), 10) - 1] AS gram
              FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS k FROM i WHERE len(ws) > 0)),
        g AS (SELECT doc_id, span, p, ws[p:p + span - 1] AS gram
              FROM (SELECT doc_id, ws, span, unnest(range(1, len(ws) - span + 2)) AS p FROM d, spans WHERE len(ws) >= span)),
        hits AS (SELECT doc_id, span, p, item_id FROM g JOIN w USING (span, gram)),
        covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + span)) AS q FROM hits) GROUP BY 1),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
                  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op10_hamming_search": """
        WITH codes AS (
            SELECT vec_id, list_aggregate(list_transform(embedding, lambda x: CASE WHEN x > 0 AND NOT isnan(x) THEN '1' ELSE '0' END), 'string_agg', '')::BIT AS code
            FROM embeddings),
        pairs AS (
            SELECT q.vec_id, r.vec_id AS neighbor_id, CAST(bit_count(xor(q.code, r.code)) AS INTEGER) AS distance
            FROM codes q JOIN codes r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0)
        SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank, neighbor_id, distance
        FROM pairs QUALIFY rank <= 10""",
}
