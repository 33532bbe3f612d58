"""Added tokens in texts get the ids that the library gives by default."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import bpe, packing, token_store
from tessera.llm.common import new_path

from .test_llm import DOCS, prose


def test_added_tokens_are_encoded_as_by_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path("byte_bpe_50k.json")
    texts = ["a <|endoftext|> b", "plain text  here", "two  <|endoftext|>\n\nx", "<|endoftext|>" * 3, "", "a <|endoftext| b", prose(1, 50) + " <|endoftext|>"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert 50256 in want[0]
    got = token_store.read_store(token_store.write_store(docs, new_path(spark, "t"), path)).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["ids_crc32"]) for r in got] == [(len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for w in want]
    packed = packing.pack(docs, path).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in packed} == dict(enumerate(map(len, want)))
