"""The token store against the plain library, and keyed access."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import packing, token_store
from tessera.llm.bpe import tokenizer_path
from tessera.llm.common import new_path

from .test_llm import DOCS, prose

PATH = tokenizer_path("byte_bpe_50k.json")
BITS = [*" \n\t\r'.,!(a1Zé²×çñ—“ \x1c\x85 　中Жб́_$\x01᠎​", "ss", "re", "ll", "'s", "'ll", "\n\n", "  ", " \n", "\r\n", "<|endoftext|>", "word", "Next"]


@pytest.fixture(scope="module")
def plain():
    tok = Tokenizer.from_file(PATH)
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


def split(ids, sizes):
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_any_text_is_encoded_as_by_the_library(plain):
    enc, rng = token_store.PieceEncoder(PATH, cache_bytes=200_000), random.Random(2)
    for _ in range(300):
        texts = ["".join(rng.choices(BITS, k=rng.randint(0, 14))) for _ in range(20)]
        assert split(*enc.encode_batch(pa.array(texts), 2)) == [plain(t) + [2] for t in texts]
        assert split(*enc.encode_batch(pa.array(texts))) == [plain(t) for t in texts]
    long = [prose(3, 30_000), "x" * 100_000, " " * 5_000, "\n" * 5_000 + "a", None, ""]
    assert split(*enc.encode_batch(pa.array(long, pa.large_string()), 2)) == [plain(t) + [2] for t in long]
    ids, sizes = enc.encode_batch(pa.array([], pa.string()), 2)
    assert len(ids) == 0 and len(sizes) == 0


def test_what_is_remembered_stays_bounded(plain):
    """Texts without spaces are one piece each; they are neither kept nor encoded otherwise than by the library."""
    enc, rng = token_store.PieceEncoder(PATH, cache_bytes=100_000), random.Random(3)
    han = [chr(c) for c in range(0x4E00, 0x4F00)]
    for _ in range(40):
        texts = ["".join(rng.choices(han, k=rng.choice([3, 150, 201, 400]))) + rng.choice(["", " tail", " hello unusualpiece here"]) for _ in range(500)]
        got = split(*enc.encode_batch(pa.array(texts), 2))
        assert got[::50] == [plain(t) + [2] for t in texts[::50]] and len(got) == 500
        assert [len(g) for g in got] == [len(plain(t)) + 1 for t in texts] if _ == 0 else True
        kept = [*enc.younger.items(), *enc.older.items()]
        assert sum(len(p) + len(i) + token_store.PIECE_BYTES for p, i in kept) <= 100_000 + 1_000 and all(len(p) <= token_store.LONGEST_KEPT for p, _ in kept)


def test_frequent_pieces_stay_remembered():
    enc = token_store.PieceEncoder(PATH, cache_bytes=60_000)
    asked = []
    ask = enc._ask
    enc._ask = lambda new: (asked.extend(new), ask(new))[1]
    for i in range(200):
        enc.encode_batch(pa.array([f"the frequent words {i} {i + 1000} word{i}x{i * 7}"]))
    assert asked.count(" frequent") == 1 and len(asked) == len(set(asked))


def test_places_of_ids_are_64_bits_wide(plain):
    """A batch may hold more ids than 32 bits can count: nothing is narrowed on the way."""
    enc = token_store.PieceEncoder(PATH)
    ids, sizes = enc.encode_batch(pa.array(["hello unusualpiece here"] * 3))
    assert sizes.dtype == np.int64 and split(ids, sizes) == [[31373, 8468, 12239, 994]] * 3


def test_parts_of_a_batch():
    batch = pa.record_batch([pa.array(["a" * 10, None, "b" * 10, "c" * 100, ""])], ["text"])
    assert [p.column("text").to_pylist() for p in token_store.by_bytes(batch, 20)] == [["a" * 10, None, "b" * 10], ["c" * 100], [""]]
    assert list(token_store.by_bytes(batch.slice(0, 0), 20)) == []


def test_lookup(spark, plain, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_BYTES", 150)
    rows = [(i, f"document {i} {'word ' * (i % 7)}") for i in range(0, 60, 2)] + [(30, f"other text {i}") for i in range(25)] + [(None, "no key"), (None, "none either"), (61, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).withColumns({"shard": F.lit("x"), "ids": F.lit(1), "path": F.lit("p")})
    manifest = token_store.write_store(docs, new_path(spark, "t"), PATH)
    assert manifest.count() > 3 and manifest.filter("first_key > last_key").isEmpty()
    asked = [0, 30, 30, 58, 61, 1, -5, 10**12, None]
    got = token_store.lookup(manifest, spark.createDataFrame([(k,) for k in asked], "doc_id long")).collect()
    want = [(i, plain(t) + [2]) for i, t in rows if i in asked]
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=str) == sorted(want, key=str)
    # only shards whose keys include the one asked for are opened
    opened = manifest.filter("first_key <= 0 and last_key >= 0").count()
    assert opened == 1 and {r["path"] for r in got if r["doc_id"] == 0} == {r["path"] for r in manifest.filter("first_key <= 0").collect() if r["first_key"] == 0}


def test_shards_are_balanced_by_bytes(spark, monkeypatch):
    rows = [(i, "long " * 400 if i < 40 else "s") for i in range(4_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    monkeypatch.setattr(token_store, "SHARD_BYTES", 16_000)
    sizes = [r["n_tokens"] for r in token_store.write_store(docs, new_path(spark, "t"), PATH).select("n_tokens").collect()]
    assert len(sizes) >= 4 and max(sizes) < 3 * sum(sizes) / len(sizes)


def test_packed_pieces_carry_their_ids(spark, plain):
    texts = [prose(1, 300), None, "", "short", prose(2, 90), "short"]
    docs = spark.createDataFrame([(i % 5, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).withColumns({"ids": F.lit("x"), "batch": F.lit(1), "__pid": F.lit(2)})
    got = packing.pack(docs, PATH, max_len=64, n_buckets=4, batch_tokens=256)
    assert got.columns == ["doc_id", "piece", "start", "n_tokens", "bucket", "padded_len", "batch", "slot", "ids"]
    texts_of = {}
    for r in got.orderBy("doc_id", "piece").collect():
        ids = np.frombuffer(r["ids"], "<u2").tolist()
        assert len(ids) == r["n_tokens"] <= 64
        texts_of.setdefault(r["doc_id"], []).extend(ids)
    for i in range(1, 5):
        assert texts_of[i] == plain(texts[i]) + [2]
    both = [plain(texts[0]) + [2], plain(texts[5]) + [2]]
    assert sorted(texts_of[0]) == sorted(both[0] + both[1])
