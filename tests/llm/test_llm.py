"""The training-data operators against SQL, brute force, round trips and held-out labels, and on odd inputs."""

import hashlib
import itertools
import random
import re
import time
import uuid
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from footfall.llm import common, components, dedup, knn, language, mixing, packing, preference, queries, secret_scan, sharding, simhash, toxicity

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, row string, fp long"
#: Nulls in any column, empty and wordless texts, repeated rows, equal texts, odd white space, a long text, columns with clashing names.
ODD = [
    (1, "Alpha beta  gamma \n delta", "en", "a", 3, "x", 1), (1, "Alpha beta  gamma \n delta", "en", "a", 3, "x", 1),
    (2, "alpha BETA  gamma \n delta", None, None, None, None, None), (3, None, None, None, None, None, None), (4, "", "en", "b", 0, "y", 2),
    (5, " \t\n", "en", "b", 3, "y", 2), (None, "alpha beta", "en", "b", 3, "y", 2), (None, None, None, None, None, None, None),
    (6, "été à l'école   ß <|endoftext|>  x", "fr", "b", 3, "y", 2), (7, "token = abcdef0123456789abcdef0123456789 AKIA" + "Q7" * 10, "en", "c", 1, "z", 3),
    (11, "<|endoftext|><|endoftext|> a <|endoftext|>b\n<|endoftext|>", "en", "c", 1, "z", 3), (8, "lorem ipsum dolor sit amet " * 4000, "en", "c", 1, "z", 3), (9, "1d10t 1d10t", "en", "c", 1, "z", 3),
]


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def odd(spark):
    return spark.createDataFrame(ODD, DOC)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE[name]})").fetchall()
    assert rows_of(df.select(*columns)) == sorted(want, key=repr)


# --- secret scan

def base_spans(text):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_base_secrets(spark):
    tricky = ["secret=token:abcdefgh", "Token==abcdef", "API_KEY : 'abcdefg", "é😀 password=\"zz-zz.zz=\" x", "AKIA" + "A" * 15, "AKIAAKIA" + "A" * 14,
              "f" * 23 + " " + "f" * 24, "token=a_token=abcdefgh", "tokentoken=ab", "passwd: abc, secret = abcdef"]
    docs = odd(spark).select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(tricky)], "doc_id long, text string"))
    for doc in (docs, documents(spark).select("doc_id", "text")):
        out = secret_scan.digest(doc)
        got = Counter((r.doc_id, r.base_sha256, r.n_assign + r.n_access + r.n_hex) for r in out.collect())
        want = Counter((r.doc_id, hashlib.sha256((s := base_spans(r.text or "")).encode()).hexdigest(), s.count(":") // 2) for r in doc.collect())
        assert got == want
    assert secret_scan.digest(docs.limit(0)).count() == 0


def test_markov_adds_random_strings(spark):
    rng = random.Random(3)
    key = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    words = ["internationalization", "configuration_manager_factory", "getElementsByClassName", "responsibilities_of_the", "characterization"]
    texts = [f"token={key(30)} and {rng.choice(words)}{rng.choice(words)} {rng.choice(words)}" for _ in range(300)]
    texts += [f"see {key(40)} here", f"see {words[0]}{words[2]} here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in secret_scan.digest(docs).collect()}
    assert spans[300] == "markov:4:44" and spans[301] == ""
    assert all(s.startswith("assign:0:") for d, s in spans.items() if d < 300)


def test_runs_outside_of_base_spans(spark):
    rng = random.Random(5)
    parts = ["token=abcdefgh", "AKIA" + "B" * 16, "f" * 24, "f" * 20, "someIdentifierName", "-/+", " ", "=", "secret: ", "é😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, 7, "mine") for i, t in enumerate(texts)], "doc_id long, text string, base int, runs string")
    for r in secret_scan.find_spans(docs).collect():
        text = texts[r.doc_id]
        base = [(int(a), int(b)) for _, a, b in (x.split(":") for x in base_spans(text).split(",") if x)]
        want = [m.span() for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}", text)]
        want = [(a, b) for a, b in want if not any(c < b and a < d for c, d in base)]
        assert [(x.start, x.stop) for x in r.runs] == want and [(x.start, x.stop) for x in r.base] == [x for x in base]


def test_scan_time_is_about_linear_in_the_matches(spark):
    def seconds(n):
        text = " ".join(f"token=abcdef{i:06d} fooBarBazQuux{i:08d}x" for i in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.monotonic()
        row = secret_scan.find_spans(docs).select(F.size("base").alias("b"), F.size("runs").alias("r")).first()
        assert (row.b, row.r) == (n, n)
        return time.monotonic() - start

    seconds(1000)
    assert seconds(64000) < 3 * seconds(32000) + 2


def test_labelled_strings_recall_and_false_alarms(spark):
    rng = random.Random(8)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    words = "load file name user account order total parse stream token buffer index node value merge table query column batch session cluster".split()
    key = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randrange(24, 48)))

    def name():
        picked = [rng.choice(words) for _ in range(rng.randrange(4, 7))]
        return rng.choice([lambda: "_".join(picked), lambda: "".join(w.title() for w in picked), lambda: "-".join(picked), lambda: "/".join(picked)])() + rng.choice(["", "2", "_v10"])

    rows = [(key(), True) for _ in range(800)] + [(name(), False) for _ in range(800)] + [(None, True), ("x", None)]
    labelled = spark.createDataFrame(rows, "value string, random boolean")
    held = [(i, (key() if i % 2 else name()), i % 2 == 1) for i in range(1000)]
    docs = spark.createDataFrame([(i, f"see {v} here") for i, v, _ in held], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in secret_scan.scan(docs, labelled=labelled).collect()}
    judged = [(i, v, is_key) for i, v, is_key in held if len(v) >= 16]
    recall = np.mean([bool(spans[i]) for i, _, is_key in judged if is_key])
    false = np.mean([bool(spans[i]) for i, _, is_key in judged if not is_key])
    assert recall > 0.95 and false < 0.02, (recall, false)


# --- language

def test_language_held_out(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    out = language.identify_held_out(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97


def test_language_odd(spark):
    model = language.train(documents(spark))
    assert {f for v in model.families.values() for f in v} == {"en", "de", "fr", "es"} and len(model.families) == 2
    got = Counter((r.doc_id, r.lang_pred) for r in language.identify(odd(spark), model).collect())
    assert got[3, "und"] == got[4, "und"] == got[5, "und"] == 1 and sum(got.values()) == len(ODD)
    assert all(0 <= r.score <= 1 for r in language.identify(odd(spark), model).collect())
    nothing = language.train(odd(spark).withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.identify(odd(spark), nothing).collect()} == {"und"}
    assert language.identify_held_out(odd(spark).limit(0)).count() == 0


# --- toxicity

def test_decoder_restores(spark):
    decoder = toxicity.Decoder(toxicity.char_model(toxicity.char_counts(documents(spark, "/root/testdata/sf0.01"))))
    for odd_text, plain in {"an 1d10t!": "an idiot!", "i d i o t": "idiot", "m.o.r.o.n": "moron", "stuuuupid": "stupid", "tr4sh": "trash", "l0s3r": "loser",
                            "i-d.i-o t": "idiot", "i  d  i  o  t": "idiot", "i\td/i,o\nt": "idiot", "id iot": "idiot", "id-iot": "idiot", "iddiott": "idiot",
                            "iidiioott": "idiot", "ii dd ii oo tt": "idiot", "1d1 0t": "idiot", "iii d i o t": "idiot", "1 2 3 4": "1 2 3 4",
                            "the 1999 was": "the 1999 was", "plain words": "plain words"}.items():
        assert decoder.restore(odd_text) == plain, odd_text


def path_cost(decoder, letters):
    total, a, b = 0.0, 0, 0
    for ch in letters:
        k = toxicity._class(ch)
        total, a, b = total + decoder.costs[a][b][k], b, k
    return total + decoder.costs[a][b][0]


def test_decoding_is_the_cheapest_path(spark):
    decoder = toxicity.Decoder(toxicity.char_model(toxicity.char_counts(documents(spark))))
    rng = random.Random(3)
    for _ in range(150):
        span = "".join(rng.choice("aadiiot1003 .-") for _ in range(rng.randint(1, 9)))
        costs = {}
        for path in itertools.product(*decoder.steps(span)):
            text = "".join(c for c, _ in path)
            costs[text] = min(costs.get(text, 1e9), sum(x for _, x in path) + path_cost(decoder, text))
        assert costs[decoder.best(span)] < min(costs.values()) + 1e-6, span


def test_long_spans_decode_as_short_ones(spark):
    decoder = toxicity.Decoder(toxicity.char_model(toxicity.char_counts(documents(spark, "/root/testdata/sf0.01"))))
    one = "i d i o t  "
    assert set(decoder.restore(", the, " + one * 3000).replace("the", "").replace(",", "").split()) == set(decoder.restore(one * 50).split())


def test_words_are_judged_once(spark):
    class Counted(toxicity.Decoder):
        judged = 0

        def _restored(self, span):
            self.judged += 1
            return super()._restored(span)

    decoder = Counted(toxicity.char_model(toxicity.char_counts(documents(spark))))
    text = "coffee, tr4sh; " * 300
    assert decoder.restore(text) == decoder.restore("coffee, tr4sh; ") * 300 and decoder.judged == 2


def test_labelled_rows_are_restored_once(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(toxicity, "stored", lambda df, name: kept.setdefault(name, common.stored(df, name)))
    docs = spark.createDataFrame([(i, "An 1d10t, a moron " * i) for i in range(1, 9)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, toxic int"))
    decoder = toxicity.Decoder(model.costs)
    assert {r.text for r in kept["labelled"].collect()} == {decoder.restore(r.text) for r in docs.collect()}


def test_character_counts_cover_all(spark):
    texts = [r.text for r in odd(spark).collect() if r.text is not None]
    counts = toxicity.char_counts(odd(spark).coalesce(1))
    assert counts.sum() == sum(map(len, texts)) + len(texts) + 1 - 2
    assert toxicity.char_counts(odd(spark).limit(0)).sum() == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"  # fewer rows hold too few toxic ones
    out = queries.QUERIES["op3_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    counts = {(r.toxic, r.predicted): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    assert counts[1, 1] / (counts[1, 1] + counts.get((1, 0), 0)) > 0.8 and counts[1, 1] / (counts[1, 1] + counts.get((0, 1), 0)) > 0.9


def test_toxicity_odd(spark):
    labels = spark.createDataFrame([(1, 0), (1, 0), (9, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    for marks in (labels, labels.limit(0)):
        out = toxicity.score_held_out(odd(spark), marks).collect()
        assert len(out) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert toxicity.score_held_out(odd(spark).limit(0), labels).count() == 0


# --- SimHash

def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    """(id, fingerprint) to the least id reachable over links of two bits, by comparing all pairs."""
    distinct = sorted({p for _, p in prints})
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for d, p in prints:
        if d is not None:
            least[find(p)].append(d)
    return sorted([(d, f"{p:016x}", min(least[find(p)], default=None)) for d, p in prints], key=repr)


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_simhash_brute_force(spark, which):
    docs = odd(spark) if which == "odd" else documents(spark)
    assert rows_of(simhash.near_duplicates(docs)) == brute_components([(r.doc_id, brute_print(r.text)) for r in docs.collect()])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [1, 100])
def test_pivot_pairs_lose_no_link(spark, limit):
    rng = random.Random(1)
    prints = {0, (1 << 64) - 1}
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(25):
            prints.add(p)
            p ^= sum(1 << rng.randrange(64) for _ in range(rng.choice([1, 2, 3]))) & ((1 << 64) - 1)
    prints |= {rng.getrandbits(64) for _ in range(100)}
    signed = [(simhash._signed(p),) for p in sorted(prints)]
    pairs = simhash.near_pairs(spark.createDataFrame(signed, "fp long"), bucket_limit=limit)
    assert all((r.a ^ r.b) % (1 << 64) and ((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 2 for r in pairs.collect())
    roots = {r.node: r.root for r in components.components(pairs).collect()}
    by_root, want = defaultdict(set), defaultdict(set)
    for d, _, c in brute_components([(p, p) for p in prints]):
        want[c].add(simhash._signed(d))
    for (p,) in signed:
        by_root[roots.get(p, p)].add(p)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(300)]
    hub = [(1000, 1001 + i) for i in range(500)]
    edges = spark.createDataFrame(path + hub + [(5, 5)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**dict.fromkeys(range(301), 0), **dict.fromkeys(range(1000, 1501), 1000)}
    assert components.components(edges.limit(0)).count() == 0


def test_a_very_long_text_is_hashed_in_blocks(monkeypatch):
    text = " ".join(str(i * i % 97) for i in range(500))
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text.encode()) % (1 << 64) == brute_print(text)


# --- packing

def check_packed(rows, docs, window=1024):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = defaultdict(list)
    for r in docs:
        ids[r.doc_id].append(np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4"))
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at == window or at & (at - 1) == 0
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        assert sum(p.length for p in pieces) == sum(map(len, ids[d]))
        if len(ids[d]) == 1:
            own, at = ids[d][0], 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(own) and p.ids_crc32 == zlib.crc32(own[at:at + p.length].tobytes())
                at += p.length


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_packing_round_trip(spark, which):
    docs = (odd(spark) if which == "odd" else documents(spark)).repartition(5, "source")
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), open_windows=3).collect()
    check_packed(rows, docs.collect())
    assert packing.pack(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_packed_sequences_hold_the_tokens(spark):
    docs = documents(spark).limit(60)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    sequences, got = defaultdict(list), defaultdict(dict)
    for r in corpus_pipeline.pack_sequences(spark, docs, SF).collect():
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert len(ids) == r.length
        sequences[r.sequence_id].append((r.offset, ids))
        got[r.doc_id][r.start] = ids
    assert {d: [i for _, ids in sorted(p.items()) for i in ids] for d, p in got.items()} == want
    tokens = [i for pieces in sequences.values() for _, ids in sorted(pieces) for i in ids]
    assert Counter(tokens) == Counter(i for ids in want.values() for i in ids)
    assert "ids" not in queries.QUERIES["op5_packing"](spark, SF).columns


def test_new_pieces_are_encoded_together(monkeypatch):
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    ids, sent, rng = encoder._ids, [], random.Random(5)
    monkeypatch.setattr(encoder, "_ids", lambda texts: sent.extend(texts) or ids(texts))
    text = "\n".join(f"start{k}. and{k}" for k in range(1000))
    odd_texts = ["".join(rng.choice(["a", "Be", "'s", "é", "7", ".", ",!", " ", " ", "\n", "\n", "\t", "\r", "\u00a0", "<|endoftext|>"])
                         for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    assert list(encoder.encode([text])) == ids([text]) and len(sent) < 20
    for at in (0, 1000):
        assert list(encoder.encode(odd_texts[at:at + 1000])) == ids(odd_texts[at:at + 1000])


def test_packer_places_best_and_emits_the_fullest():
    p = packing.Packer(0, window=8, limit=2)
    ids = lambda n: bytes(4 * n)
    for d, n in enumerate([5, 6, 2]):
        p.add(d, 0, ids(n), n)
    assert [r[0] for r in p.taken()] == [1, 2]
    p.add(3, 0, ids(7), 7)
    p.add(4, 0, ids(4), 4)
    assert [(r[0], r[2]) for r in p.taken()] == [(3, 7), (4, 1)] and sorted(u for u, _ in p.open) == [3, 5]


# --- sharding

def test_shards_fit_and_split_only_where_needed(spark):
    rng = random.Random(2)
    data = [(i, rng.randrange(200)) for i in range(500)] + [(7, 90)] * 40 + [(7, 0), (None, 30), (None, None), (999, 5000)]
    rows = spark.createDataFrame(data, "key long, n long")
    out = sharding.shards(rows, "key", F.col("n"), 1000).collect()
    assert Counter((r.key, r.n_bytes) for r in out) == Counter((k, n or 0) for k, n in data)
    total, depth = Counter(), {}
    for r in out:
        total[r.shard, r.page] += r.n_bytes
        depth[r.shard] = r.depth
        assert len(r.shard) == r.depth
    assert all(r.shard_bytes == total[r.shard, r.page] for r in out)
    assert all(n <= 1000 or n == 5000 for n in total.values())
    for s in depth:  # no shard is a prefix of another, and a split parent was too large
        assert not any(t != s and t.startswith(s) for t in depth)
        assert not s or sum(n for (t, _), n in total.items() if t.startswith(s[:-1])) > 1000
    assert sharding.shards(rows.limit(0), "key", F.col("n"), 1000).count() == 0


# --- mixing

def test_rates_bring_token_totals_to_targets(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.5, 0.5, 0.5], 400)
    tokens = rng.integers(1, 900, 400)
    members = spark.createDataFrame([(int(t), [float(x) for x in row]) for t, row in zip(tokens, p, strict=True)], "tokens long, p array<double>")
    targets = {"a": 0.6, "b": 0.3, "c": 0.1}
    steps = mixing.descend(members, ["a", "b", "c"], targets)
    got = np.array([r[0] for r in members.select(mixing.rate(F.col("p"), steps, 0.0, 8.0)).collect()])
    want = np.ones(400)
    for s in steps:
        want = np.clip(want - p @ np.array(s), 0, 8)
    assert np.allclose(got, want)
    assert np.allclose((tokens * want) @ p / tokens.sum(), [0.6, 0.3, 0.1], atol=2e-3) and want.min() >= 0
    grown = mixing.descend(members, ["a", "b", "c"], targets, least=1.0, grow=True)
    r = np.array([x[0] for x in members.select(mixing.rate(F.col("p"), grown, 1.0, 8.0)).collect()])
    assert r.min() >= 1 and mixing.descend(members.limit(0), ["a", "b", "c"], targets) == []


@pytest.mark.parametrize("which", ["soft", "rare", "impossible"])
def test_the_fit_ends_only_at_its_targets_or_best(spark, which):
    rng = np.random.default_rng(6)
    tokens = rng.integers(1, 900, 2000)
    if which == "soft":
        targets, least, most = {"a": 0.90, "b": 0.08, "c": 0.02}, 0.0, None
        p = rng.dirichlet([6, 0.9, 0.95], 2000)
    else:
        targets, least, most = {"a": 0.9, "b": 0.1}, 0.0, None if which == "rare" else 4.0
        p = np.eye(2)[(rng.random(2000) < 0.01).astype(int)]
    members = spark.createDataFrame([(int(t), [float(x) for x in row]) for t, row in zip(tokens, p, strict=True)], "tokens long, p array<double>")
    steps = mixing.descend(members, sorted(targets), targets, **({"most": most} if most else {}))
    rates = members.withColumn("rate", mixing.rate(F.col("p"), steps, least, most))
    r = np.array([x.rate for x in rates.collect()])
    totals = (tokens * r) @ p / tokens.sum()
    if which == "impossible":
        natural = tokens @ p / tokens.sum()
        assert np.allclose(totals, [0.9, 4 * natural[1]], atol=2e-3) and r.max() == 4
    else:
        assert np.allclose(totals, list(targets.values()), atol=1.1e-3) and r.min() >= 0
        assert np.allclose(list(mixing.reached(rates, sorted(targets)).values()), totals / totals.sum())


def test_posteriors_brute_force(spark):
    rng = random.Random(2)
    usual = [f"w{i}" for i in range(60)]
    marks = {"high": ["fine", "sound"], "low": ["spam", "junk"], "toxic": ["vile"]}

    def text(d):
        return rng.choice([" ", "\n", " \t"]).join(rng.choices(usual, k=rng.randrange(1, 30)) + rng.choices(marks[d] + usual[:3], k=4))

    rows = [(text(d), d) for d in marks for _ in range(200)]
    model = mixing.train(spark.createDataFrame([*rows, ("x", None), (None, "low")], "text string, domain string"), "domain")
    texts = [text(d) for d in marks for _ in range(40)] + ["", None, " \n "]
    got = mixing.memberships(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    right = 0
    for t, r in zip(texts, got, strict=True):
        words = [w for w in re.split("[ \t-\r]+", t or "") if w]
        seen = {np.int64(np.uint64(xxhash.xxh64_intdigest(w, 42))).item() % mixing.BUCKETS for w in words}
        x = [prior + factor / max(len(seen), 1) ** power * sum(logs[b] for b in seen) for prior, logs, (factor, power) in (model[d] for d in sorted(model))]
        e = np.exp(np.array(x) - max(x))
        assert r.tokens == len(words) and np.allclose(r.p, e / e.sum())
        right += r.doc_id < 120 and sorted(marks)[int(np.argmax(r.p))] == list(marks)[r.doc_id // 40]
    assert right > 100


def test_mixing_odd(spark):
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 0), (8, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for marks in (labels, labels.limit(0)):
        rated, names = mixing.mix(odd(spark), mixing.labelled_rows(odd(spark), marks), {"high": 0.5, "low": 0.5})
        out = rated.collect()
        assert len(out) == len(ODD) and all(r.rate >= 0 and len(r.p) == len(names) for r in out)
        assert all(abs(sum(r.p) - 1) < 1e-9 for r in out if names)
    assert mixing.mix(odd(spark).limit(0), mixing.labelled_rows(odd(spark), labels), {"high": 1.0})[0].count() == 0


# --- exact dedup

def test_exact_dedup_odd(spark):
    out = dedup.exact_duplicates(odd(spark), dedup.DigestIndex(spark, f"t_{uuid.uuid4().hex}")).collect()
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = defaultdict(list)
    for r in ODD:
        groups[hashlib.sha256(lower(r[1]).encode()).hexdigest()].append(r[0])
    assert Counter((r.doc_id, r.text_sha256, r.group_size) for r in out) == Counter((d, g, len(v)) for g, v in groups.items() for d in v)
    for g, ids in groups.items():
        own = [r for r in out if r.text_sha256 == g]
        best = max((d for d in ids if d is not None), default=None)
        assert all(r.keep_id == best for r in own) and [r.doc_id for r in own if r.kept] == [best]
    assert dedup.exact_duplicates(odd(spark).limit(0), dedup.DigestIndex(spark, f"t_{uuid.uuid4().hex}")).count() == 0


def test_the_index_persists(spark):
    name = f"t_{uuid.uuid4().hex}"
    first = spark.createDataFrame([(5, "a"), (6, "b")], "doc_id long, text string")
    second = spark.createDataFrame([(7, "A"), (8, "c")], "doc_id long, text string")
    dedup.exact_duplicates(first, dedup.DigestIndex(spark, name)).collect()
    out = {r.doc_id: (r.keep_id, r.kept) for r in dedup.exact_duplicates(second, dedup.DigestIndex(spark, name)).collect()}
    assert out == {7: (5, False), 8: (8, True)} and spark.table(name).count() == 3


# --- preference formatting

def test_preference_pairs(spark):
    a = [("user", "hi"), ("assistant", "yo"), ("user", "more"), ("assistant", "good")]
    cases = [(a, [*a[:3], ("assistant", "bad"), ("user", "x")]), (a, a), (a[:2], a), (None, a), (a, None), ([], [])]
    pairs = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"k int, chosen array<{preference.TURN}>, rejected array<{preference.TURN}>")
    render = lambda t: "".join(f"<|{r}|>\n{x}<|end|>\n" for r, x in t)
    for r in preference.format_pairs(pairs).collect():
        chosen, rejected = (c or [] for c in cases[r.k])
        n = next((i for i, (x, y) in enumerate(zip(chosen, rejected, strict=False)) if x != y), min(len(chosen), len(rejected)))
        assert (r.shared_turns, r.prompt, r.chosen, r.rejected) == (n, render(chosen[:n]), render(chosen[n:]), render(rejected[n:]))
        for rest, text, mask in ((chosen[n:], r.chosen, r.chosen_mask), (rejected[n:], r.rejected, r.rejected_mask)):
            spans = [tuple(map(int, s.split(":"))) for s in mask.split(",") if s]
            assert [text[i:j] for i, j in spans] == [f"{x}<|end|>" for role, x in rest if role == "assistant"]


def test_preference_odd_turns(spark):
    turns = spark.createDataFrame([
        (0, 0, None, None), (0, 1, "assistant", "a"), (0, 1, "assistant", "a"), (1, None, "user", "q"), (1, 2, "assistant", None), (2, 0, "user", "z"),
        (3, 0, "assistant", "z"), (None, 0, "assistant", "n"), (6, 0, "assistant", "lone")], "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in preference.format_pairs(preference.parted(turns)).collect()}
    # all with a reply, each against the next one; the last against the first
    assert set(out) == {0, 1, 3, 6}
    assert out[0].shared_turns == 1 and out[0].chosen_mask == "14:22,37:45" and out[0].rejected_mask == "14:21"
    assert out[1].shared_turns == 1 and out[1].chosen_mask == "14:21" and out[1].rejected == "<|assistant|>\nz<|end|>\n"
    assert out[6].prompt == "" and out[6].rejected.count("<|assistant|>") == 2
    assert preference.parted(turns.limit(0)).count() == 0
    lone = preference.format_pairs(preference.parted(turns.filter("conv_id = 6"))).first()
    assert (lone.shared_turns, lone.chosen, lone.rejected) == (1, "", "")


def test_every_conversation_with_a_reply_makes_a_pair(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    pairs = preference.parted(turns).collect()
    want = defaultdict(list)
    for r in turns.filter("conv_id is not null").collect():
        want[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "user", r.text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in want.items()}
    usable = sorted(c for c, v in own.items() if any(role == "assistant" for role, _ in v))
    assert sorted(p.conv_id for p in pairs) == usable
    partner = dict(zip(usable, usable[1:] + usable[:1], strict=True))
    replies = {c: [i for i, (role, _) in enumerate(own[c]) if role == "assistant"] for c in usable}
    for p in pairs:
        c, o = p.conv_id, partner[p.conv_id]
        j = c % len(replies[c])
        assert [tuple(t) for t in p.chosen] == own[c]
        assert [tuple(t) for t in p.rejected] == own[c][:replies[c][j]] + own[o][replies[o][min(j, len(replies[o]) - 1)]:]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 99, 100, 101, 5000])
def test_running_sums(spark, n):
    numbers = [(7 * i) % 13 for i in range(n)]
    out = spark.createDataFrame([(numbers,)], "x array<int>").select(common.running_sums(F.col("x")).alias("s")).first().s
    assert out == [sum(numbers[:i]) for i in range(n)] if n < 200 else out[-1] == sum(numbers[:-1])


# --- top-k

def brute_top_k(rows, k):
    out = []
    good = [(i, d, np.floor(1024 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, (d, v) in enumerate(rows)
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, _, v in good), default=0)
    good = [(i, d, np.pad(v, (0, width - len(v)))) for i, d, v in good]
    for i, d, v in good:
        if d is not None and d % 100 == 0:
            best = sorted((-int(v @ w), float("inf") if e is None else e, j) for j, e, w in good if j != i)[:k]
            out += [(d, n + 1, None if e == float("inf") else e, -s) for n, (s, e, j) in enumerate(best)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("tight", [True, False])
def test_top_k_brute_force(spark, tight):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(6, 8)) * 4
    rows = [(i, [float(x) for x in centers[i % 6] + rng.normal(size=8) * (0.05 if tight else 3)]) for i in range(900)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [rows[0], rows[100]]
    rows += [(2000, None), (2001, [None] * 8), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (2100, [1.0, 2.0]), (2200, []), (None, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    query = F.col("vec_id") % 100 == 0
    got = rows_of(knn.top_k(df, query, pivots=12, group_queries=3, block_rows=100))
    assert got == brute_top_k(rows, 10)
    assert knn.top_k(df.limit(0), query).count() == 0
    assert rows_of(knn.top_k(df.filter("vec_id < 4"), query)) == brute_top_k([r for r in rows if r[0] is not None and r[0] < 4], 10)


# --- pipeline

def test_pipeline_stages(spark):
    docs = documents(spark)
    kept = docs.columns
    toxic = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert toxic.columns == kept and 0 < toxic.count() < docs.count() + 1
    once = corpus_pipeline.drop_copies(spark, docs, SF)
    lower = defaultdict(list)
    for r in docs.collect():
        lower[re.sub("[A-Z]", lambda m: m[0].lower(), r.text)].append(r.doc_id)
    assert once.columns == kept and sorted(r.doc_id for r in once.collect()) == sorted(max(v) for v in lower.values())
    apart = corpus_pipeline.drop_near_copies(spark, docs, SF)
    classes = brute_components([(r.doc_id, brute_print(r.text)) for r in docs.collect()])
    assert apart.columns == kept and sorted(r.doc_id for r in apart.collect()) == sorted({c for _, _, c in classes})
    mixed = corpus_pipeline.mix_domains(spark, docs, SF)
    assert mixed.columns == kept and {r.doc_id for r in mixed.collect()} == {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_pipeline_mixing_moves_the_shares_to_its_targets(spark):
    sf = "/root/testdata/sf0.1"
    docs = documents(spark, sf)
    rows = mixing.labelled_rows(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    model = mixing.train(rows.filter(F.col("domain").isin(list(corpus_pipeline.TARGETS))), "domain")
    mixed = corpus_pipeline.mix_domains(spark, docs, sf)

    def shares(df):
        parts = [F.sum(F.col("tokens") * F.element_at("p", i + 1)) / F.sum("tokens") for i in range(len(model))]
        return dict(zip(sorted(model), mixing.memberships(df.select("doc_id", "text"), model).agg(*parts).first(), strict=True))

    before, after = shares(docs), shares(mixed)
    rarer = min(before, key=before.get)
    assert all(abs(after[d] - w) < 5e-3 for d, w in corpus_pipeline.TARGETS.items())
    assert after[rarer] > 1.5 * before[rarer] and mixed.count() > 1.05 * docs.count()


@pytest.mark.parametrize("empty", [True, False])
def test_pipeline_odd(spark, tmp_path, empty):
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    (odd(spark).limit(0) if empty else odd(spark)).write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert bool(rows) != empty
