"""The training-data operators against brute force, round trips and edge cases."""

import base64
import hashlib
import io
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, neardup, packing, quality, secrets, sharding, token_store, topk, toxicity, warc
from tessera.llm.common import new_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i % 12]}{i}" for i in rng.integers(0, 4000, n))


@pytest.fixture(scope="module")
def texts():
    a = prose(1, 60)
    near = a.rsplit(" ", 3)[0] + " other ending words"
    odd = [None, "", "one", "One  ONE", " \t\n", "a b c d", "x" * 50_000, "  two  gaps \n\n and\tlines ", "line\nline\nline\nother",
           "w " * 30, "it's 's", "é ñ 漢字 😀 　 end", " " * 6000 + "x", "y" + "\n" * 5000]
    return [a, a, a.upper(), near, prose(2, 40), prose(3, 400), *odd]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).withColumns({"key": F.lit("clash"), "probability": F.lit(0.5), "slot": F.lit(1)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- secrets ----

def test_secrets(docs, texts, empty):
    t = "password: hunter2 api_key=Zq8#vT!p2LmX0 token = \"0123456789abcdef0123\" AKIA" + "A1" * 8 + " secret: secret: abcdefghijkl"
    base, every, _ = secrets.find_secrets(t)
    kinds = [secrets.KINDS[k] for _, k, _ in base]
    assert kinds.count("assign") == 1 and kinds.count("access") == 1 and kinds.count("hex") == 1
    assert any(k == 3 and t[s:e].startswith("Zq8#") for s, k, e in every)
    assert set(base) <= set(every)
    assert secrets.scan(docs).count() == len(texts) and secrets.scan(empty).count() == 0
    assert "Zq8#" not in secrets.redact_text(t) and secrets.redact_text("plain words") == "plain words"


def test_guess_cost_is_the_cheapest_segmentation():
    assert secrets.guess_bits("password") < 10 < secrets.guess_bits("kq7Zx!mw") and secrets.guess_bits("aaaaaaaaaaaa") < 15
    assert secrets.guess_bits("qwertyuiop") < 20 and secrets.guess_bits("2019-12-31") < 20 and secrets.guess_bits("") == 0
    assert secrets.guess_bits("Xv9" * 20_000) > 1000  # linear time


# ---- near duplicates ----

def brute_components(texts):
    sets = []
    for t in texts:
        w = neardup.normal_words(t).split(b" ") if neardup.normal_words(t) else []
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    comp = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * len(sets[i] | sets[j]):
            a, b = sorted((comp[i], comp[j]))
            comp = [a if c == b else c for c in comp]
    return {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, comp))}


def test_near_duplicates(docs, texts, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == brute_components(texts)
    assert neardup.near_duplicates(empty).count() == 0
    assert neardup.keep_one(docs).columns == docs.columns


def test_near_duplicates_with_a_shared_passage(spark):
    shared = prose(9, 60)
    many = [f"{shared} {prose(100 + i, 28 + i % 3)}" for i in range(25)] + [f"{shared} {prose(100, 28)} x"] + [prose(7, 50)] * 20
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(many)], DOCS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(d).collect()}
    assert got == brute_components(many)


def test_prefix_filter_keeps_every_similar_pair(spark):
    base = prose(5, 80).split()
    many = [" ".join(base[:k] + [f"z{k}"] + base[k + 1:]) for k in range(0, 80, 4)]
    t = spark.createDataFrame(list(enumerate(many)), "id long, text string").select("id", neardup.packed("text").alias("words"))
    b = neardup.prefix_buckets(t)
    other = b.select("key", F.col("id").alias("j"))
    met = {(r[0], r[1]) for r in b.join(other, "key").select("id", "j").distinct().collect()}
    sets = [set(neardup.shingle_hashes(neardup.normal_words(x)).tolist()) for x in many]
    assert all((i, j) in met for i, j in itertools.combinations(range(len(many)), 2) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]))


def test_blocks_find_what_brute_force_finds(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    base = prose(5, 80).split()
    many = [" ".join(base[:k] + [f"z{k}"] + base[k + 1:] + ([f"y{k}"] * (k % 7))) for k in range(0, 80, 8)]
    texts = spark.createDataFrame(list(enumerate(many)), "id long, text string").select("id", neardup.packed("text").alias("words"))
    bucket = texts.select(F.lit(1).cast("long").alias("key"), "id", F.col("id").alias("comp"))
    bucket = bucket.union(bucket.withColumn("key", F.lit(2).cast("long"))).withColumn("n_shingles", F.lit(80))
    dealt = neardup.deal(bucket)
    assert dealt.select("key").distinct().count() == 1 and dealt.select("lo", "hi").distinct().count() > 1
    comp = list(range(len(many)))
    for u, v in neardup.match_blocks(dealt, texts).collect():
        a, b = sorted((comp[u], comp[v]))
        comp = [a if c == b else c for c in comp]
    assert comp == [c for _, c in brute_components(many).values()]


# ---- toxicity ----

def test_toxicity_learns_and_holds_out(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, prose(i, 60) + (" you zorgon blarf zorgon" if bad else ""), int(bad)))
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string").withColumn("probability", F.lit(0))
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(d, labels).toPandas().set_index("doc_id")
    assert len(got) == 402 and got["score"].between(0, 1).all() and rng is not None
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert got["held_out"].sum() == len(held) + sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in (900, 901))
    truth = {i: y for i, _, y in rows}
    assert np.mean([got["predicted"][i] == truth[i] for i in held]) > 0.95
    kept = toxicity.drop_toxic(d, labels)
    assert kept.columns == d.columns and 290 <= kept.count() <= 310


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score_documents(docs, none).collect()} == {0.0}


# ---- WARC ----

def test_warc_round_trip(spark):
    long = "<p>" + "x" * 200
    pages = spark.createDataFrame([(5, "u", long), (3, "u", long), (4, None, None), (6, "v", "short"), (7, "v", "short"), (8, "w\r\n", "é" * 60)], "page_id long, url string, html string")
    a = warc.write_archives(pages, new_path(spark, "t"))
    got = {r["page_id"]: r for r in warc.read_archives(a).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {3: ("response", None), 5: ("revisit", 3), 4: ("response", None), 6: ("response", None), 7: ("response", None), 8: ("response", None)}
    assert got[5]["payload_digest"] == hashlib.sha256(long.encode()).hexdigest() and got[5]["payload_bytes"] == 203
    none = warc.write_archives(pages.limit(0), new_path(spark, "t"))
    assert warc.read_archives(none).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_warc_salvage(packed):
    made = []
    for i in range(6):
        body = f"payload {i} ".encode() * 40
        r = warc.build_record(i, "http://x", body, None, hashlib.sha256(body).hexdigest())
        made.append(warc.gzip_member(r) if packed else r)
    broken = bytearray(made[2])
    broken[len(broken) // 2] ^= 0xFF
    data = b"junk" + made[0] + made[1] + bytes(broken) + made[3] + made[4][:-30] + made[5]
    items = list(warc.SalvageReader(io.BytesIO(data)))
    assert [x[2]["x-page-id"] for x in items if x[0] == "record"] == ["0", "1", "3", "5"]
    gaps = [(s, e) for k, s, e, _ in (x for x in items if x[0] == "gap")]
    assert sum(e - s for s, e in gaps) == 4 + len(broken) + len(made[4]) - 30


# ---- token store ----

def test_token_store(spark, docs, texts):
    path = bpe.tokenizer_path("byte_bpe_50k.json")
    m = token_store.write_store(docs, new_path(spark, "t"), path)
    got = [tuple(r) for r in token_store.read_store(m).orderBy("doc_id").collect()]
    tok, start, want = token_store.load_tokenizer(path), 0, []
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_token_store_repeated_null_and_empty(spark, empty, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_BYTES", 40)
    rows = [(None, "n n n n", "", "", 0)] + [(7, "same text here", "", "", 0)] * 20 + [(i, f"doc {i}", "", "", 0) for i in range(10)]
    d = spark.createDataFrame(rows, DOCS)
    got = token_store.read_store(token_store.write_store(d, new_path(spark, "t"), bpe.tokenizer_path("byte_bpe_50k.json"))).orderBy("start").collect()
    assert len(got) == len(rows) and [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k))
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:]))
    assert token_store.read_store(token_store.write_store(empty, new_path(spark, "t"), bpe.tokenizer_path("byte_bpe_50k.json"))).count() == 0


def test_perfect_hash():
    keys = token_store.mix(np.arange(5000, dtype=np.uint64), 1)
    h = token_store.PerfectHash.build(keys)
    assert sorted(h.slots(keys)) == list(range(5000))


# ---- quality ----

def brute_quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    win = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    cover = {i + k for i, x in enumerate(win) if win.count(x) > 1 for k in range(5)} if len(win) < 3000 else set()
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_quality(docs, texts, empty):
    got = {r["doc_id"]: tuple(r)[1:6] for r in quality.judge(docs).collect()}
    assert got == {i: brute_quality(t) for i, t in enumerate(texts)}
    assert quality.judge(empty).count() == 0 and quality.keep_good(docs).columns == docs.columns


# ---- sharding ----

def brute_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2147483648.0 / ((key >> 33) + 1)))
    return b


def test_sharding(spark, docs, empty):
    keys = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for n in (1, 8, 9):
        assert sharding.jump_hash(keys, n).tolist() == [brute_jump(int(k), n) for k in keys]
    got = sharding.assign_shards(docs).collect()
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in got)
    assert sharding.assign_shards(empty).count() == 0
    same = spark.createDataFrame([(1, "x", "", "", 0)] * 100 + [(None, None, "", "", 0)] * 3, DOCS)
    assert sharding.assign_shards(same.repartition(4)).filter("doc_id = 1").select("slot").distinct().count() == 100


# ---- BPE ----

def test_bpe(docs, texts):
    import public_tokenizers

    path = bpe.tokenizer_path("byte_bpe_multi_50k.tiktoken")
    enc = bpe.load_encoding(path, public_tokenizers.PATTERN)
    got = {r["doc_id"]: r for r in bpe.digest_round_trip(docs, path, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    long = (prose(4, 3000) + "  \n ") * 10 + " " * 9000
    assert bpe.encode_text(enc, long) == enc.encode_ordinary(long) and len(list(bpe.safe_parts(long))) > 2
    assert enc.decode_bytes(bpe.encode_text(enc, " " * 1_000_000 + "x")) == b" " * 1_000_000 + b"x" and base64 is not None


# ---- packing ----

def test_optimal_bounds():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = int(rng.integers(1, 8))
        lengths = np.sort(rng.choice(np.arange(1, 40), n, replace=False))
        counts = rng.integers(1, 9, n)
        for k in (1, 2, 3):
            cost = lambda b: sum(c * min(x for x in b if x >= v) for v, c in zip(lengths, counts))
            best = min(cost((*s, lengths[-1])) for m in range(min(k, n)) for s in itertools.combinations(lengths[:-1], m))
            bounds = packing.optimal_bounds(lengths, counts, k)
            assert len(bounds) <= k and cost(bounds) == best


def test_packing(docs, texts, empty):
    path = bpe.tokenizer_path("byte_bpe_50k.json")
    got = packing.pack(docs, path, max_len=64, n_buckets=4, batch_tokens=256).toPandas()
    tok = token_store.load_tokenizer(path)
    for i, t in enumerate(texts):
        mine = got[got.doc_id == i].sort_values("piece")
        assert mine["n_tokens"].sum() == len(tok.encode(t or "", add_special_tokens=False).ids) + 1
        assert mine["start"].tolist() == [64 * k for k in range(len(mine))]
    sizes = got.groupby(["bucket", "batch"]).agg(n=("slot", "size"), top=("slot", "max"), pad=("padded_len", "max"))
    assert (sizes.n * sizes["pad"] <= 256).all() and (sizes.n == sizes.top + 1).all() and (got.n_tokens <= got.padded_len).all()
    assert packing.pack(empty, path).count() == 0


# ---- top-k ----

def test_topk(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(0, 0.3, (700, 16)).astype(np.float32)
    m[100:300] = m[100]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    rows += [(1000, None), (1100, [1.0, None]), (1200, [float("nan")] * 16), (None, [0.1] * 16)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = np.floor(1024 * m.astype(np.float64)).astype(np.int64)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(d).collect()}
    want = {}
    for i in range(0, 700, 100):
        s = q @ q[i]
        order = sorted((j for j in range(700) if j != i), key=lambda j: (-s[j], j))[:10]
        want |= {(i, k + 1): (j, int(s[j])) for k, j in enumerate(order)}
    assert got == want
    assert topk.top_k(d.limit(0)).count() == 0


# ---- pipeline ----

def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit("x"))
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        n = docs.count()
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        assert docs.columns == columns and 0 < docs.count() <= n, name
    packed = cp.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()
