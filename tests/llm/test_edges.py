"""Odd rows of sharding and byte-level BPE, and a whole run of the pipeline."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, neardup, packing, quality, secrets, sharding, toxicity
from tessera.llm.common import shared_dir, table

from .test_llm import DOCS, SF, brute_components, prose
from .test_quality import brute_verdicts


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None, None), (None, "x"), (1, ""), (1, "same"), (1, "same"), (2, prose(2, 30_000)), (-5, "é漢😀\n" * 3), (2**62, "z" * 200_000)]
    return rows, rows_of(spark, rows).withColumns({"size": F.lit("s"), "law": F.lit(1), "ids": F.lit(2), "__local": F.lit(3)})


def test_sharding_of_odd_rows(spark, odd):
    rows, docs = odd
    got = sharding.assign_shards(docs).collect()
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    assert {r["law"] for r in got} == {"key"} and all(r["grown_shard"] in (r["shard"], 8) for r in got)
    for s in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    for i in (1, None):
        assert len({r["shard"] for r in got if r["doc_id"] == i}) == 1


def test_only_the_new_shard_grows(spark):
    got = sharding.assign_shards(rows_of(spark, [(i, "t") for i in range(9_000)])).toPandas()
    moved = got[got.grown_shard != got.shard]
    assert set(moved.grown_shard) == {8} and abs(len(moved) - 1000) < 150


def test_bpe_of_odd_rows(spark, odd):
    import public_tokenizers

    path = bpe.tokenizer_path("byte_bpe_multi_50k.tiktoken")
    enc = bpe.load_encoding(path, public_tokenizers.PATTERN)
    rows, docs = odd
    got = bpe.digest_round_trip(docs, path, public_tokenizers.PATTERN).collect()
    assert sorted(r["decoded_sha256"] for r in got) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows)
    want = sorted(hashlib.sha256(np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest() for _, t in rows)
    assert sorted(r["ids_sha256"] for r in got) == want
    assert bpe.digest_round_trip(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("text", [" " * 10_000, " " * 10_000 + "x", "a" + "\n" * 9_000 + "b", "a" + "\t" * 9_000 + "\n" + "b", ("w" + " " * 5_000) * 3, "x" * 70_000 + " \n" * 5_000])
def test_long_white_space_match_by_match(text):
    import public_tokenizers
    import regex

    enc = bpe.load_encoding(bpe.tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    want = []
    for m in regex.finditer(public_tokenizers.PATTERN, text):
        want += enc._encode_single_piece(m.group().encode())
    assert bpe.encode_text(enc, text) == want


# ---- pipeline ----

def plain_run(docs, labels_of):
    """The stages behind the classifier, without Spark: kept (doc_id, text)."""
    verdicts = brute_verdicts([(d["lang"], d["source"], d["text"]) for d in docs])
    docs = [d for i, d in enumerate(docs) if verdicts[i]]
    comp = brute_components([d["text"] for d in docs])
    least = {}
    for i, d in enumerate(docs):
        least[comp[i][1]] = min(least.get(comp[i][1], d["doc_id"]), d["doc_id"])
    docs = [d for i, d in enumerate(docs) if d["doc_id"] == least[comp[i][1]]]
    words = secrets.load_words(bpe.tokenizer_path(secrets.VOCABULARY))
    return {d["doc_id"]: secrets.redact_text(d["text"], words) for d in docs}


def test_run_gives_the_rows_of_the_plain_stages(spark):
    import corpus_pipeline as cp
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.tokenizer_path("byte_bpe_50k.json"))
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    clean = [r.asDict() for r in toxicity.drop_toxic(docs, labels).collect()]
    want = plain_run(clean, labels)
    got = {}
    for r in sorted(cp.run(spark, SF).collect(), key=lambda r: (r["doc_id"], r["piece"])):
        ids = np.frombuffer(r["ids"], "<u2").tolist()
        assert len(ids) == r["n_tokens"] <= r["padded_len"]
        got.setdefault(r["doc_id"], []).extend(ids)
    assert len(want) > 100
    assert got == {i: tok.encode(t, add_special_tokens=False).ids + [2] for i, t in want.items()}


def test_stages_take_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp

    rows = [(None, None), (None, prose(1, 40)), (3, prose(1, 40)), (3, prose(1, 40)), (3, prose(2, 40)), (4, ""), (5, "password = abcdefghijklmnop " + prose(5, 40)), (6, prose(6, 5_000))]
    table(spark, SF, "labels").write.parquet(str(tmp_path / "labels.parquet"))
    odd = rows_of(spark, rows)
    for docs in (odd.withColumns({"kept": F.lit("k"), "score": F.lit(1), "__key": F.lit("x"), "__row": F.lit(1), "__score": F.lit(2), "__gone": F.lit(3)}), odd.limit(0)):
        columns = docs.columns
        for name, stage in cp.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
            assert docs.columns == columns, name
        texts = [r["text"] for r in docs.collect()]
        if texts:
            assert len(texts) == 5 and sum("[SECRET]" in t for t in texts) == 1 and texts.count(prose(1, 40)) == 2
        packed = cp.STAGES[-1][1](spark, docs, str(tmp_path))
        assert packed.select("doc_id", "piece").count() >= len(texts)
    assert packed.count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        @staticmethod
        def get(key, default=None):
            return default

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError):
        shared_dir(Session)
    Context.master = "local[2]"
    assert shared_dir(Session)
