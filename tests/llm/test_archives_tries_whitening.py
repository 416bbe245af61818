"""WARC archives, conversation tries and whitening against brute force, round trips and odd inputs."""

import base64
import gzip
import hashlib
import io
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from footfall.llm import language, queries, trie, warc, whitening

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, row string, sha1 long, bytes string, chunk int"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- WARC

#: Nulls in any column, empty and long payloads, repeated rows, equal payloads, payloads that look like record ends, clashing names.
ODD_PAGES = [
    (5, "http://a/x", "same", "r", 1, "b", 2), (3, "http://a/y z\r\nX: 1", "same", "r", 1, "b", 2), (5, "http://a/x", "same", None, None, None, None),
    (9, None, None, None, None, None, None), (8, "http://b", "", "r", 1, "b", 2), (None, "http://c", "same", "r", 1, "b", 2), (None, None, "only", "r", 1, "b", 2),
    (10, "é://ü", "WARC/1.1\r\n\r\n\r\nHTTP/1.1 200 OK\r\n\r\nß" * 5, "r", 1, "b", 2), (11, "http://long", "<p>long é</p>" * 40_000, "r", 1, "b", 2),
    (12, "http://long/2", "<p>long é</p>" * 40_000, "r", 1, "b", 2), (13, "http://near", "<p>long é</p>" * 40_000 + "x", "r", 1, "b", 2), (1, "u", "alone", "r", 1, "b", 2),
]


def test_archives_of_odd_pages(spark):
    got = rows_of(warc.digest(spark.createDataFrame(ODD_PAGES, PAGES)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    groups = defaultdict(list)
    for page in ODD_PAGES:
        groups[(page[2] or "").encode()].append(page[0])
    want = []
    for payload, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        want += [(ids[0], len(payload), digest, "response", None)] + [(i, len(payload), digest, "revisit", ids[0]) for i in ids[1:]]
    assert got == sorted(want, key=repr)


def test_small_payloads_are_all_responses(spark):
    got = warc.digest(spark.createDataFrame(ODD_PAGES, PAGES), least_bytes=5).filter("payload_bytes < 100")
    assert {r["record_type"] for r in got.collect()} == {"response"}


def test_empty_table_of_pages(spark):
    assert warc.digest(spark.createDataFrame([], PAGES)).collect() == []


def test_payloads_come_back_in_chunks(spark, tmp_path):
    pages = spark.createDataFrame(ODD_PAGES, PAGES)
    manifest = warc.write_archives(pages, str(tmp_path), chunk_bytes=1000, archive_bytes=2000)
    assert manifest.count() > 1 and manifest.agg(F.sum("records")).first()[0] == len(ODD_PAGES)
    found = warc.read_archives(spark, manifest, chunk_bytes=700).collect()
    assert max(len(r["bytes"]) for r in found) <= 700
    payloads, digests = defaultdict(bytes), {}
    for r in sorted(found, key=lambda r: (r["record_id"], r["chunk"])):
        if r["record_type"] == "response":
            payloads[r["record_id"]] += r["bytes"]
            digest = base64.b32encode(hashlib.sha1(payloads[r["record_id"]]).digest()).decode()
            assert r["digest"] == digest and r["total"] == len(payloads[r["record_id"]])  # carried along, chunk by chunk
            digests[r["record_id"]] = digest, r["stated_digest"], r["last"]
    assert all(a == b and last for a, b, last in digests.values())
    assert sorted(payloads.values()) == sorted({(p[2] or "").encode() for p in ODD_PAGES})
    revisits = [r for r in found if r["record_type"] == "revisit"]
    assert revisits and all(r["refers_to_record"] in payloads for r in revisits)


def test_archives_are_plain_gzip_members(spark, tmp_path):
    name = warc.write_archives(spark.createDataFrame(ODD_PAGES[-1:], PAGES), str(tmp_path)).first()["archive"]
    data = gzip.open(name.removeprefix("file://")).read()
    first, second = data.split(b"\r\n\r\n\r\n\r\n") if b"\r\n\r\n\r\n\r\n" in data else re.split(rb"\r\n\r\n(?=WARC/1\.1)", data)
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and second.startswith(b"WARC/1.1\r\nWARC-Type: response")
    assert second.endswith(b"\r\n\r\nalone\r\n\r\n")


def test_reads_archives_of_other_writers():
    data = (b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\na: b\n\r\n\r\n"
            b"WARC/1.0\nwarc-type: resource\nWARC-Target-URI: http://x\n /y\ncontent-length: 6\n\nABC\r\nD\r\n\r\n"
            b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: 23\r\n\r\nHTTP/1.1 404 No\r\n\r\nbody\r\n\r\n"
            b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: 4\r\n\r\nbare\r\n\r\n"
            b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    for raw in (data, gzip.compress(data), gzip.compress(data[:70]) + gzip.compress(data[70:])):
        got = [(r[3], r[4], r[10]) for r in warc.records(io.BufferedReader(io.BytesIO(raw)), "x", 1000)]
        assert got == [("warcinfo", None, b"a: b\n"), ("resource", "http://x /y", b"ABC\r\nD"), ("response", None, b"body"), ("response", None, b"bare"), ("metadata", None, b"")]
    for broken in (data[:-300], b"no archive", data.replace(b"Content-Length: 4", b"Content-Length: x")):
        with pytest.raises(ValueError, match="x at"):
            list(warc.records(io.BufferedReader(io.BytesIO(broken)), "x"))


# --- trie


def brute_nodes(conversations):
    """Nodes from {conv_id: [(role, text), ...]} by the definition."""
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[c] for c in children[node])
    return sorted(((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node],
                    hashlib.sha256(",".join(map(str, sorted(c for c in m if len(conversations[c]) == len(node)))).encode()).hexdigest())
                   for node, m in members.items()), key=repr)


def brute_regrown(conversations):
    def h(c):
        return zlib.crc32(str(c).encode()) % 4
    return {c: conversations.get(c - c % 20, [])[: h(c)] + turns[h(c):] for c, turns in conversations.items()}


def table_of(spark, conversations):
    rows = [(c, k, role, text) for c, turns in conversations.items() for k, (role, text) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("shard_turns", [7, 60, 100_000])
def test_trie_against_brute_force(spark, shard_turns):
    """Few different turns, so that paths are shared by many shards; copies whose members fill several ranges of ids; a long conversation."""
    r = random.Random(shard_turns)
    texts = ["", "a b", "c", "d  e\tf", "\n"]
    conversations = {c * 37: [(r.choice(["u", "v"]), r.choice(texts)) for _ in range(r.randint(1, 6))] for c in range(260)}
    conversations |= {100_000 + 500 * c: [("u", "a b"), ("v", "c")] for c in range(60)}
    conversations[7] = [("u", "a b"), ("v", "c")] * 150
    conversations[8] = [("u", "a b"), ("v", "c")] * 100 + [("u", "x")]
    sequences = trie.encoded(table_of(spark, conversations))
    assert rows_of(trie.prefix_nodes(sequences, shard_turns).select(*trie.RESULT)) == brute_nodes(conversations)
    got = rows_of(trie.prefix_nodes(trie.regrown(sequences), shard_turns).select(*trie.RESULT))
    assert got == brute_nodes(brute_regrown(conversations))


def test_trie_of_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, id long, ids string, words string, code long"
    rows = [(1, 0, "u", "a"), (1, None, "u", "first"), (1, None, "u", "first"), (2, 5, None, None), (2, 7, "u", "a"), (None, 0, "u", "lost"), (None, None, None, None),
            (3, None, "", ""), (4, 0, "u", "tie"), (4, 0, "v", "tie"), (5, 0, "v", "tie"), (5, 0, "u", "tie"), (-7, 0, "u", "long " * 50_000)]
    table = spark.createDataFrame([(*row, 1, "x", "y", 2) for row in rows], schema)
    tied = [("u", "tie"), ("v", "tie")]
    tied.sort(key=lambda t: hashlib.sha256(f"{len(t[0])}:{t[0]}{t[1]}".encode()).digest())
    want = {1: [("u", "first"), ("u", "first"), ("u", "a")], 2: [("", ""), ("u", "a")], 3: [("", "")], 4: tied, 5: tied, -7: [("u", "long " * 50_000)]}
    assert rows_of(trie.prefix_nodes(trie.encoded(table)).select(*trie.RESULT)) == brute_nodes(want)
    assert trie.prefix_nodes(trie.regrown(trie.encoded(table.limit(0)))).collect() == []


def test_conversation_without_turns_ends_at_the_root(spark):
    """Conversation 21 (crc32 % 4 > 0) has a turn that its missing beginning takes away."""
    lost = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 0)
    conversations = {lost: [("u", "a b c")], 41: [("u", "x")]}
    got = rows_of(trie.prefix_nodes(trie.regrown(trie.encoded(table_of(spark, conversations)))).select(*trie.RESULT))
    assert brute_regrown(conversations)[lost] == [] and got == brute_nodes(brute_regrown(conversations))


def test_tree_is_balanced():
    tree = trie.TernaryTree()
    for i in trie._medians_first(1023):
        tree.insert([i], [1], 1, i, "")
    depth, level = 0, [tree.equal[0]]
    while level:
        depth, level = depth + 1, [n for at in level for n in (tree.low[at], tree.high[at]) if n >= 0]
    assert depth == 10


# --- whitening


def test_slicing_equals_a_dense_solver():
    r = np.random.default_rng(3)
    for dims in (1, 2, 7, 40):
        a = r.standard_normal((4 * dims, dims)) * np.linspace(0.05, 5, dims)
        v = a.T @ a / len(a)
        values, vectors = whitening.leading(v)
        np.testing.assert_allclose(values, np.linalg.eigvalsh(v)[::-1][:32], rtol=1e-11)
        np.testing.assert_allclose(v @ vectors, vectors * values, atol=1e-12 * values[0])


def test_slicing_of_equal_and_missing_eigenvalues():
    q, _ = np.linalg.qr(np.random.default_rng(4).standard_normal((9, 9)))
    for spectrum in ([3, 3, 3, 2, 2, 1, 0, 0, 0], [1] * 9, [5, 5 - 1e-13, 1e-3, 1e-6, 0, 0, 0, 0, 0], [0] * 9):
        v = (q * np.array(spectrum, float)) @ q.T if any(spectrum) else np.zeros((9, 9))
        values, vectors = whitening.leading(v)
        assert len(values) == sum(s > 0 for s in spectrum)
        np.testing.assert_allclose(values, [s for s in spectrum if s > 0], rtol=1e-7)
        np.testing.assert_allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)


def test_inertia_counts():
    r = np.random.default_rng(5)
    for _ in range(300):
        dims = r.integers(1, 10)
        a = r.integers(-3, 4, (dims, dims)).astype(float)
        a, shift = a + a.T, float(r.choice([0.0, 1.0, 0.5, -0.3, 2.2]))
        values = np.linalg.eigvalsh(a)
        if np.abs(values - shift).min() > 1e-9:
            assert whitening.inertia(a, shift) == (values > shift).sum()


def test_whitening_against_numpy(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    data = {r["vec_id"]: np.floor(64 * np.array(r["embedding"], dtype=float)) + 1_000_000 for r in vectors.collect()}
    x = np.array(list(data.values()))
    v = np.cov(x.T, bias=True)
    values, found = np.linalg.eigh(v)
    values, found = values[::-1][:32], found[:, ::-1][:, :32]
    found = found * np.sign(found[np.abs(found).argmax(axis=0), range(32)])
    want = dict(zip(data, (x - x.mean(axis=0)) @ found / np.sqrt(values), strict=True))
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    rows = queries.QUERIES["op13_spectrum_whitening"](spark, SF).collect()
    assert len(rows) == 32 * n and len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9
    for r in rows:
        assert r["n"] == n and abs(r["whitened"] - want[r["vec_id"]][r["component"] - 1]) < 1e-7
        assert abs(r["explained"] / (values[r["component"] - 1] / np.trace(v)) - 1) < 1e-9
        assert r["deviation"] == sum((n * int(a) - s) ** 2 for a, s in zip(data[r["vec_id"]], sums, strict=True))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [3.0, 2.5]), (2, [3.0, 2.5]), (None, [0.0, -1.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [1.0, inf]), (7, []),
            (8, [1.0]), (9, [1e300, 1.0]), (10, [2.0, 7.0])]
    table = spark.createDataFrame([(*r, "x", 3, 4.0) for r in rows], "vec_id long, embedding array<double>, vector string, n long, component double")
    model = whitening.fit(table)
    assert model.n == 5 and len(model.values) == 2
    got = whitening.whiten(table, model, error=whitening.identity_error(table, model)).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in got) == sorted((str(i), c) for i in (1, 2, 2, None, 10) for c in (1, 2))
    assert whitening.identity_error(table, model) < 1e-12
    flat = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    for none in (table.limit(0), table.filter("vec_id = 3"), flat):
        assert whitening.whiten(none, whitening.fit(none)).collect() == []


def test_deviations_beyond_a_long():
    model = whitening.Whitening(1 << 40, (0, 0), np.ones(0), np.zeros((2, 0)), 1.0)
    assert model.deviations(np.array([[1, 0], [1 << 45, 1]])) == [None, None]
    model = whitening.Whitening(1 << 20, (5, 7), np.ones(0), np.zeros((2, 0)), 1.0)
    assert model.deviations(np.array([[3, -2]])) == [(3 * (1 << 20) - 5) ** 2 + (-2 * (1 << 20) - 7) ** 2]


def test_signs_that_are_no_letters():
    assert not any(language.has_letter(t) for t in ("", "12 _", "²", "① ½", "٣"))
    assert all(language.has_letter(t) for t in ("a", "² é", "12ß", "漢", "ª"))
