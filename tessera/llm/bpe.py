"""Byte-level BPE encoding and decoding with the tiktoken library.

The ranks come from a local file. Long texts are cut at safe boundaries before
they reach the library: no match of the split pattern runs from a non-space
character into a space that a non-space character follows, so cutting before such
a space leaves every match as it was. A white-space run too long for the library's
regex engine is one match by the pattern (without its last character, where text
follows) and is encoded as that one piece. Decoding joins the tokens' raw bytes.

Edge cases: null texts are empty; an empty text has no tokens; texts without any
safe boundary are encoded in one go; rows that repeat each give a row; an empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import table

LONG_TEXT = 1 << 16
LONG_SPACE = 4096
_SAFE = re.compile(r"(?<=[^\s]) (?=[^\s])")
_SPACES = re.compile(r"[ \t\n\r\x0b\x0c]{%d,}" % LONG_SPACE)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def load_encoding(path: str, pattern: str):
    """A tiktoken encoding without special tokens; one per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, size: int = LONG_TEXT) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, cut at safe boundaries."""
    start = 0
    while len(text) - start > size:
        found = _SAFE.search(text, start + size)
        if not found:
            break
        yield text[start:found.start()]
        start = found.start()
    yield text[start:]


def encode_text(enc, text: str) -> list[int]:
    ids: list[int] = []
    for part in safe_parts(text):
        at = 0
        for run in _SPACES.finditer(part) if len(part) >= LONG_SPACE else ():
            ids += enc.encode_ordinary(part[at:run.start()])
            following = run.end() < len(part)
            piece = run.group()[:-1] if following else run.group()
            if following and part[run.end()].isspace():  # other white space goes on: leave the run to the library
                at = run.start()
                continue
            ids += enc._encode_single_piece(piece.encode())
            at = run.start() + len(piece)
        ids += enc.encode_ordinary(part[at:])
    return ids


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every text."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        enc = load_encoding(path, pattern)
        return texts.map(lambda t: np.array(encode_text(enc, t or ""), np.int32))

    return docs.select("doc_id", run(F.coalesce("text", F.lit(""))).alias("ids"))


def decode_ids(enc, ids) -> bytes:
    return enc.decode_bytes([int(i) for i in ids])


def digest_round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes every text, decodes the ids, and returns digests of both."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(texts: pd.Series) -> pd.DataFrame:
        enc = load_encoding(path, pattern)
        rows = []
        for text in texts:
            ids = encode_text(enc, text or "")
            rows.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", run("text").alias("__r")).select("doc_id", "__r.*")


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op8_bpe": op8_bpe}
SQL: dict[str, str] = {}
