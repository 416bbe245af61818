"""The training-data operators as registered queries over whole tables, with SQL where it can express them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import dedup, knn, language, mixing, packing, preference, secret_scan, sharding, simhash, toxicity, trie, warc, whitening
from footfall.llm.common import table

QUERIES, ORACLE = {}, {}
TOKENIZER = "byte_bpe_50k.json"


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


@query("op4_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_packing")
def pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op8_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
      FROM documents)
WINDOW g AS (PARTITION BY text_sha256)
""")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = dedup.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    return dedup.exact_duplicates(table(spark, sf_dir, "documents"), index).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op2_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_held_out(table(spark, sf_dir, "documents"))


@query("op3_toxicity")
def score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_voronoi_top_k", """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score, q.r
    FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
""")
def voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op1_secret_scan")
def scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


SHARD_BYTES = 1 << 20


@query("op6_extendible_sharding", f"""
WITH r AS (
    SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash
    FROM documents),
l AS (
    SELECT depth, hash >> (60 - depth) AS bucket, sum(n_bytes) AS total, min(hash) AS low, max(hash) AS high
    FROM r, range(0, 61) t(depth) GROUP BY ALL),
f AS (
    SELECT r.doc_id, r.n_bytes, r.hash, min_by(l.total, l.depth) AS total, min(l.depth) AS depth
    FROM r, l WHERE l.bucket = r.hash >> (60 - l.depth) AND (l.total <= {SHARD_BYTES} OR l.low = l.high)
    GROUP BY r.doc_id, r.n_bytes, r.hash)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(hash >> (60 - depth)), depth::INTEGER, '0') END AS shard,
       depth::INTEGER AS depth, 0::BIGINT AS page, total::BIGINT AS shard_bytes
FROM f
""")
def extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), "doc_id", F.octet_length("text"), SHARD_BYTES)


@query("op9_preference_format", """
WITH t AS (
    SELECT conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS k
    FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT conv_id, k, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS n FROM t WHERE role = 'assistant'),
m AS (SELECT conv_id, max(n) AS m FROM r GROUP BY conv_id),
p AS (
    SELECT conv_id, m, 1 + ((conv_id % m) + m) % m AS j, coalesce(lead(conv_id) OVER (ORDER BY conv_id), min(conv_id) OVER ()) AS other
    FROM m),
q AS (
    SELECT p.conv_id, p.other, a.k AS left_at, b.k AS taken_up
    FROM p JOIN m o ON o.conv_id = p.other JOIN r a ON a.conv_id = p.conv_id AND a.n = p.j
    JOIN r b ON b.conv_id = p.other AND b.n = least(p.j, o.m)),
c AS (SELECT t.* FROM t JOIN m USING (conv_id)),
e AS (
    SELECT c.conv_id, c.role, c.text, c.k FROM c JOIN q USING (conv_id) WHERE c.k < q.left_at
    UNION ALL
    SELECT q.conv_id, t.role, t.text, t.k - q.taken_up + q.left_at FROM q JOIN t ON t.conv_id = q.other AND t.k >= q.taken_up),
d AS (
    SELECT conv_id, k, c.role IS NOT DISTINCT FROM e.role AND c.text IS NOT DISTINCT FROM e.text AS same
    FROM c FULL JOIN e USING (conv_id, k)),
s AS (SELECT conv_id, coalesce(min(k) FILTER (NOT same), max(k) + 1) - 1 AS shared FROM d GROUP BY conv_id),
l AS (
    SELECT conv_id, k, side, role, shared, k <= shared AS inside, '<|' || role || '|>' || chr(10) AS head, text,
           '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS line
    FROM (SELECT 'c' AS side, * FROM c UNION ALL SELECT 'r', * FROM e) JOIN s USING (conv_id)),
o AS (
    SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY conv_id, side, inside ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           + length(head) AS pos
    FROM l),
g AS (SELECT *, CASE WHEN role = 'assistant' THEN pos::BIGINT || ':' || (pos + length(text) + 7)::BIGINT END AS span FROM o)
SELECT conv_id, shared::INTEGER AS shared_turns,
       coalesce(string_agg(line, '' ORDER BY k) FILTER (inside AND side = 'c'), '') AS prompt,
       coalesce(string_agg(line, '' ORDER BY k) FILTER (NOT inside AND side = 'c'), '') AS chosen,
       coalesce(string_agg(span, ',' ORDER BY k) FILTER (NOT inside AND side = 'c'), '') AS chosen_mask,
       coalesce(string_agg(line, '' ORDER BY k) FILTER (NOT inside AND side = 'r'), '') AS rejected,
       coalesce(string_agg(span, ',' ORDER BY k) FILTER (NOT inside AND side = 'r'), '') AS rejected_mask
FROM g GROUP BY conv_id, shared
""")
def preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_pairs(preference.parted(table(spark, sf_dir, "conversations")))


#: Shares of all tokens that each domain shall have.
MIX = {"high": 0.90, "low": 0.08, "toxic": 0.02}


@query("op7_soft_mixing")
def soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rated, names = mixing.mix(docs.select("doc_id", "text"), mixing.labelled_rows(docs, labels), MIX, keep=True)
    p = {d: F.element_at("p", i + 1) for i, d in enumerate(names)}
    return rated.select("doc_id", "tokens", *[F.round(p.get(d, F.lit(0.0)), 6).alias(f"p_{d}") for d in MIX], F.round("rate", 6).alias("rate"))


_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[{g}] >> {b}) & 31) + 1, 1)" for g in range(1, 9) for b in (15, 10, 5, 0))


@query("op11_warc_chunks", f"""
WITH p AS (
    SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first,
           [('0x' || substr(sha1(coalesce(html, '')), 5 * g + 1, 5))::BIGINT FOR g IN range(0, 8)] AS v
    FROM pages)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p
""")
def warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(table(spark, sf_dir, "pages"))


@query("op12_conversation_trie", r"""
WITH w AS (
    SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS code,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
    FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, code) AS k FROM w),
c AS (  -- CRC-32, a bit at a time
    SELECT conv_id, conv_id - conv_id % 20 AS start,
           xor(list_reduce([4294967295::BIGINT] || flatten([[ord(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR x IN string_split(conv_id::VARCHAR, '')]),
                           lambda a, x: CASE WHEN xor(a, x) & 1 = 1 THEN xor(xor(a, x) >> 1, 3988292384) ELSE xor(a, x) >> 1 END), 4294967295) % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
    SELECT c.conv_id, 0 AS part, k, code, words FROM c JOIN t ON t.conv_id = c.start AND t.k <= c.h
    UNION ALL SELECT c.conv_id, 1, k, code, words FROM c JOIN t ON t.conv_id = c.conv_id AND t.k > c.h),
p AS (
    SELECT conv_id, row_number() OVER g AS depth, string_agg(code, '/') OVER g AS path, words FROM r WINDOW g AS (PARTITION BY conv_id ORDER BY part, k)
    UNION ALL SELECT conv_id, 0, '', 0 FROM c),
q AS (SELECT *, lag(path) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
n AS (
    SELECT path, any_value(parent) AS parent, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(words) AS words,
           sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM q GROUP BY path),
k AS (SELECT parent AS path, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
s AS (
    SELECT q.path, sum((n.n_convs - 1) * n.words) AS saved_tokens, count_if(k.n_children IS NULL) AS n_leaves
    FROM n JOIN q ON q.conv_id = n.conv_id AND q.depth <= n.depth LEFT JOIN k ON k.path = n.path GROUP BY q.path)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
       coalesce(k.n_children, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s USING (path) LEFT JOIN k USING (path) LEFT JOIN n up ON up.path = n.parent
""")
def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_nodes(trie.regrown(trie.encoded(table(spark, sf_dir, "conversations"))))


@query("op13_spectrum_whitening")
def spectrum_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors)
    return whitening.whiten(vectors, model, error=whitening.identity_error(vectors, model) if model else None)
