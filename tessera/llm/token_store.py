"""Token-ID files with a minimal perfect hash index.

A store is a set of shards in ascending key order. Each shard has two files:

``*.ids``  raw token ids, little-endian, 2 bytes each (4 where the vocabulary needs it);
``*.mph``  the index: for n keys, a minimal perfect hash onto 0..n-1 (levels of bit
           sets: at each level the keys that meet no other key take their bit, the
           rest go on), and per slot a 32-bit fingerprint, the offset and the length.

A lookup hashes the key, finds its level and rank, compares the fingerprint and
reads one slice of the payload: constant time, whatever the shard's size.

Encoding uses the tokenizers library. Texts are cut where the byte-level splitter
always starts a new pre-token (see ``_CUTS``), each different piece is encoded by the
library, remembered within bounds, and the ids are joined. Texts that hold an added token, such
as <|endoftext|>, are encoded whole.

Edge cases: null texts are empty (their ids are the end id alone); null keys sort
first; rows that repeat a key are kept, told apart by their occurrence number within
the shard, and may be spread over neighbouring shards; an empty table has no shard
and gives no rows; a text of any length is one document of one shard; ``lookup`` of an
absent key gives no row. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .bpe import tokenizer_path
from .common import cut, new_path, open_fs, table

END_ID = 2
SHARD_BYTES = 32 << 20
MAX_SHARDS = 1 << 15  # bounds what driver and tasks know of the shards; larger inputs have larger ones
MAGIC = b"MPHTOK1\n"
GAMMA = 2.0
MAX_LEVELS = 48
MANIFEST = "shard int, path string, n_docs long, n_tokens long, first_key long, last_key long, has_null boolean"
CACHE_BYTES = 128 << 20
PIECE_BYTES = 150  # what a remembered piece takes besides its characters and ids
LONGEST_KEPT = 200
# The splitter's letters and digits up to U+024F, ASCII marks, and white space.
_WORD, _MARK, _SPACE = "0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "!-/:-@\\[-`{-~", r"\s\x0b\x1c-\x1f\x{85}\x{180e}\p{Z}"
_CUT = "\x01"
#: Where texts are cut: no pre-token runs from anything into a space with text behind
#: it, from a word into a mark, or over either end of a single line break between texts.
_CUTS = (
    (f" ([^{_SPACE}{_CUT}])", f"{_CUT} \\1"),
    (f"([{_WORD}])([{_MARK}])", f"\\1{_CUT}\\2"),
    (f"([^{_SPACE}{_CUT}])\\n([{_WORD}])", f"\\1\n{_CUT}\\2"),
)
_SPACED = f"^ [^{_SPACE}](\\n|[^{_SPACE}])*$"  # its only space comes first
_BARE = f"^[^{_SPACE}]+$"


# ---- encoding -----------------------------------------------------------

@functools.lru_cache(maxsize=2)
def load_tokenizer(path: str):
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def load_encoder(path: str) -> "PieceEncoder":
    """The encoder of this Python worker, which keeps what it knows for later tasks."""
    return PieceEncoder(path)


class PieceEncoder:
    """Encodes batches of texts and remembers the ids of pieces, up to CACHE_BYTES.

    Arrow cuts the texts into pieces and numbers the different ones of the batch; only
    pieces not remembered reach the library, many at a time: those whose only space comes
    first one after the other, as a piece begins where a token begins with a space; those
    without white space in lines of their own; others one by one. The ids of the texts
    are gathered by number, from the ids of this batch's pieces alone.

    Pieces are remembered in two generations: when the younger one holds half of
    CACHE_BYTES it becomes the older one, whose pieces move on when they are seen again, so that
    frequent ones stay. Pieces of over LONGEST_KEPT characters are never remembered.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        self.tok = load_tokenizer(path)
        size = self.tok.get_vocab_size()
        self.width = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.whole = "|".join(map(re.escape, [_CUT, *added]))  # texts with one of these are encoded whole
        self.opens = np.array([(self.tok.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        self.line = self._ids("\n")[0]
        self.most, self.held = cache_bytes, 0
        self.younger: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.width)

    def _ask(self, new: list[str]) -> Iterator[tuple[str, bytes]]:
        """(piece, its ids as bytes) of pieces that aren't remembered."""
        array = pa.array(new, pa.string())
        spaced, bare = (pc.match_substring_regex(array, p).to_numpy(zero_copy_only=False) for p in (_SPACED, _BARE))
        kind = np.where(spaced, 0, np.where(bare, 1, 2)).tolist()
        width = self.width.itemsize
        for k, apart in enumerate(("", "\n", None)):
            some = [piece for piece, its in zip(new, kind) if its == k]
            for lo in range(0, len(some), 4096):
                part = some[lo:lo + 4096]
                if apart is not None:
                    ids = self._ids(apart.join(part))
                    if apart:
                        last = np.append(np.flatnonzero(ids == self.line), len(ids))
                        first = np.append(0, last[:-1] + 1)
                    else:
                        first = np.flatnonzero(self.opens[ids])
                        last = np.append(first[1:], len(ids))
                if apart is None or len(first) != len(part):
                    yield from ((piece, self._ids(piece).tobytes()) for piece in part)
                    continue
                raw = ids.tobytes()
                yield from zip(part, (raw[f:t] for f, t in zip((first * width).tolist(), (last * width).tolist())))

    def _remember(self, piece: str, ids: bytes) -> None:
        if len(piece) > LONGEST_KEPT:
            return
        self.younger[piece] = ids
        self.held += PIECE_BYTES + len(piece) + len(ids)
        if 2 * self.held > self.most:
            self.younger, self.older, self.held = {}, self.younger, 0

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        """The ids of different pieces, in their order."""
        found = list(map(self.younger.get, pieces))
        absent = [i for i, ids in enumerate(found) if ids is None]
        unknown = []
        for i in absent:
            ids = self.older.get(pieces[i])
            if ids is None:
                unknown.append(i)
            else:
                found[i] = ids
                self._remember(pieces[i], ids)
        place = {pieces[i]: i for i in unknown}
        for piece, ids in self._ask(list(place)) if place else ():
            found[place[piece]] = ids
            self._remember(piece, ids)
        return found

    def encode_batch(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text), each text closed by end_id."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        whole = pc.match_substring_regex(texts, self.whole)
        marked = pc.if_else(whole, "", texts)
        runs = pc.match_substring_regex(marked, f" [{_SPACE}{_CUT}]")
        cut = pc.replace_substring(marked, " ", f"{_CUT} ")  # the first cut, where white space never follows a space
        if pc.any(runs).as_py():
            cut = pc.if_else(runs, pc.replace_substring_regex(pc.if_else(runs, marked, ""), *_CUTS[0]), cut)
        marked = cut
        for what, by in _CUTS[1:]:
            marked = pc.replace_substring_regex(marked, what, by)
        split = pc.split_pattern(marked, _CUT)
        coded = split.flatten().dictionary_encode()
        known = self._ids_of(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(known), self.width)
        of_piece = np.fromiter(map(len, known), np.int64, len(known)) // self.width.itemsize
        begin = np.cumsum(of_piece) - of_piece
        codes = coded.indices.to_numpy()
        ends = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        taken = of_piece[codes]
        upto = np.append(0, np.cumsum(taken, dtype=np.int64))
        ids = flat[np.repeat(begin[codes] - upto[:-1], taken) + np.arange(upto[-1])]
        upto = upto[ends]
        sizes = np.diff(upto)
        odd = np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist()
        if odd:
            parts, at = [], 0
            for i in odd:
                own = self._ids(texts[i].as_py())
                parts += [ids[at:upto[i]], own]
                at, sizes[i] = upto[i], len(own)
            ids = np.concatenate([*parts, ids[at:]])
        if end_id is not None:
            ids = np.insert(ids, np.cumsum(sizes), end_id)
            sizes = sizes + 1
        return ids, sizes


def binary_rows(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One binary value for each stretch of ``sizes`` ids."""
    ends = np.append(0, np.cumsum(sizes)) * ids.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(ids.tobytes())]).cast(pa.binary())


def by_bytes(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` bytes of the column text, a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
    part = (np.cumsum(sizes) - sizes) // most
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
    for lo, hi in zip(starts, [*starts[1:], len(part)]):
        yield batch.slice(int(lo), int(hi - lo))


# ---- minimal perfect hash -----------------------------------------------

def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective 64-bit mixer, seeded."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))


class PerfectHash:
    """Minimal perfect hash of distinct unsigned 64-bit keys."""

    def __init__(self, sizes: list[int], bits: list[np.ndarray]):
        self.sizes, self.bits = sizes, bits
        words = np.concatenate(bits) if bits else np.empty(0, np.uint64)
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum([len(b) for b in bits])]).astype(np.int64)
        self.words = words

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        sizes, bits, left = [], [], keys
        for level in range(MAX_LEVELS):
            if not len(left):
                return cls(sizes, bits)
            size = max(64, int(GAMMA * len(left)))
            at = mix(left, level + 1) % np.uint64(size)
            counts = np.bincount(at.astype(np.int64), minlength=size)
            word = np.zeros((size + 63) // 64, np.uint64)
            own = np.flatnonzero(counts == 1)
            np.bitwise_or.at(word, own >> 6, np.uint64(1) << (own & 63).astype(np.uint64))
            sizes.append(size)
            bits.append(word)
            left = left[counts[at.astype(np.int64)] > 1]
        raise ValueError("keys are not distinct")

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for some of the keys that were never added."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = (mix(keys[todo], level + 1) % np.uint64(size)).astype(np.int64)
            w = self.start[level] + (at >> 6)
            bit = np.uint64(1) << (at & 63).astype(np.uint64)
            hit = (self.words[w] & bit) != 0
            below = np.bitwise_count(self.words[w] & (bit - np.uint64(1))).astype(np.int64)
            out[todo[hit]] = self.rank[w[hit]] + below[hit]
            todo = todo[~hit]
        return out


def key_hash(ids: np.ndarray, present: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """64-bit key of (document id or null, occurrence number)."""
    base = mix(ids.astype(np.int64).view(np.uint64), 101)
    base = np.where(present, base, np.uint64(0x5851F42D4C957F2D))
    return mix(base ^ mix(occurrence.astype(np.uint64), 103), 107)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 211) >> np.uint64(32)).astype("<u4")


# ---- files --------------------------------------------------------------

def index_bytes(ids: np.ndarray, present: np.ndarray, lengths: np.ndarray, width: int) -> bytes:
    """The index of a shard whose documents lie in this order in the payload."""
    n = len(ids)
    occurrence = np.zeros(n, np.int64)
    if n:
        new = np.append(True, (ids[1:] != ids[:-1]) | (present[1:] != present[:-1]))
        occurrence = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
    keys = key_hash(ids, present, occurrence)
    h = PerfectHash.build(keys)
    slot = h.slots(keys)
    offsets = np.cumsum(lengths) - lengths
    prints, off, size = np.zeros(n, "<u4"), np.zeros(n, "<i8"), np.zeros(n, "<i8")
    prints[slot], off[slot], size[slot] = fingerprint(keys), offsets, lengths
    parts = [*(b.astype("<u8").tobytes() for b in h.bits), prints.tobytes(), off.tobytes(), size.tobytes(),
             ids.astype("<i8").tobytes(), present.astype("u1").tobytes(), occurrence.astype("<i8").tobytes()]
    body = b"".join(parts)
    head = json.dumps({"n": n, "width": width, "levels": h.sizes, "crc": zlib.crc32(body)}).encode() + b"\n"
    return MAGIC + head + body


class Shard:
    """Keyed access to one shard."""

    def __init__(self, fs, path: str):
        with fs.open_input_file(path + ".mph") as f:
            data = f.read()
        if not data.startswith(MAGIC):
            raise ValueError(f"{path}: not an index")
        stop = data.index(b"\n", len(MAGIC)) + 1
        head, body = json.loads(data[len(MAGIC):stop]), data[stop:]
        if zlib.crc32(body) != head["crc"]:
            raise ValueError(f"{path}: damaged index")
        self.n, self.width = head["n"], np.dtype(f"<u{head['width']}")
        at = 0

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(body, kind, n, at)
            at += got.nbytes
            return got

        bits = [take("<u8", (s + 63) // 64) for s in head["levels"]]
        self.hash = PerfectHash(head["levels"], bits)
        self.prints, self.offsets, self.lengths = take("<u4", self.n), take("<i8", self.n), take("<i8", self.n)
        self.ids, self.present, self.occurrence = take("<i8", self.n), take("u1", self.n).astype(bool), take("<i8", self.n)
        self.payload = fs.open_input_file(path + ".ids")

    def find(self, ids: np.ndarray, present: np.ndarray, occurrence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offset, length) in ids of each key; length -1 where the key is absent."""
        keys = key_hash(ids, present, occurrence)
        slot = self.hash.slots(keys)
        ok = slot >= 0
        ok[ok] = self.prints[slot[ok]] == fingerprint(keys[ok])
        at = np.where(ok, slot, 0)
        if not self.n:
            return np.zeros(len(keys), np.int64), np.full(len(keys), -1)
        return np.where(ok, self.offsets[at], 0), np.where(ok, self.lengths[at], -1)

    def read(self, offset: int, length: int) -> np.ndarray:
        w = self.width.itemsize
        return np.frombuffer(self.payload.read_at(length * w, offset * w), self.width)


# ---- Spark --------------------------------------------------------------

def _key_bounds(docs: DataFrame, n_shards: int) -> list[int]:
    """Keys that cut the table into shards of about equal bytes.

    Only the balance hangs on them: they are quantiles of a sample in which a document
    stands once for each 256th of a shard's bytes, long ones several times.
    """
    if n_shards < 2:
        return []
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    unit = max(1.0, total / n_shards / 256)
    share = F.coalesce(F.octet_length("text"), F.lit(0)) / F.lit(unit)
    chance = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = docs.select(F.col("doc_id").cast("long").alias("k"), F.floor(share + chance).cast("int").alias("n")).filter("n > 0")
    probs = [i / n_shards for i in range(1, n_shards)]
    got = drawn.select("k", F.explode(F.sequence(F.lit(1), F.col("n")))).agg(F.percentile_approx("k", probs, max(10_000, 4 * n_shards))).first()[0]
    return list(got or [])


def encode_documents(docs: DataFrame, path: str, bounds: list[int] | None = None, end_id: int | None = END_ID) -> DataFrame:
    """doc_id, shard, n_tokens and ids (raw little-endian bytes) of every text."""
    bounds = bounds or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load_encoder(path)
        seen = 0
        for batch in batches:
            for some in by_bytes(batch):
                ids, sizes = enc.encode_batch(some.column("text"), end_id)
                keys, shard = some.column("doc_id").to_pylist(), []
                for k in keys:
                    left = 0 if k is None else bisect.bisect_left(bounds, k)
                    right = left if k is None else bisect.bisect_right(bounds, k)
                    shard.append(left + seen % (right - left + 1))
                    seen += 1
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(shard, pa.int32()), pa.array(sizes), binary_rows(ids, sizes)], ["doc_id", "shard", "n_tokens", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, shard int, n_tokens long, ids binary")


def write_store(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> DataFrame:
    """Write the store; returns its manifest: shard, path, n_docs, n_tokens, first_key
    and last_key (both null for null keys alone), has_null, start (ids in earlier
    shards). Names carry a fresh id and the manifest names only what finished tasks
    wrote, so retried tasks leave at most unused files."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = max(1, min(MAX_SHARDS, -(-int(total) // SHARD_BYTES)))
    encoded = encode_documents(docs, path, _key_bounds(docs, n_shards), end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        width = load_encoder(path).width.itemsize
        made, now, out = [], None, None
        keys: list = []
        lengths: list[int] = []

        def close():
            out.close()
            present = np.array([k is not None for k in keys], bool)
            ids = np.array([0 if k is None else k for k in keys], np.int64)
            sizes = np.array(lengths, np.int64)
            with fs.open_output_stream(f"{root}/{made[-1][1]}.mph") as f:
                f.write(index_bytes(ids, present, sizes, width))
            made[-1][2:] = [len(ids), int(sizes.sum()), *((int(ids[present].min()), int(ids[present].max())) if present.any() else (None, None)), not present.all()]

        for batch in batches:
            for shard, doc_id, n, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "n_tokens", "ids"))):
                if shard != now:
                    if out is not None:
                        close()
                    now, keys, lengths = shard, [], []
                    made.append([shard, f"shard-{shard:06d}-{uuid.uuid4().hex}"])
                    out = fs.open_output_stream(f"{root}/{made[-1][1]}.ids")
                keys.append(doc_id)
                lengths.append(n)
                out.write(data)
        if out is not None:
            close()
        columns = zip(*[(s, f"{folder}/{name}", *rest) for s, name, *rest in made]) if made else [[]] * 7
        kinds = (pa.int32(), pa.string(), *[pa.int64()] * 4, pa.bool_())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in MANIFEST.split(", ")])

    placed = encoded.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("doc_id"))
    manifest = cut(placed.mapInArrow(write, MANIFEST), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def lookup(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id, path, offset, n_tokens and ids of the documents with the keys asked for
    (column doc_id of ``keys``; repeated and null ones count once). Only shards whose key
    range holds a key are opened, and each key is found through the shard's index. A key
    that several documents have gives all of them; an absent key gives no row.

    The manifest has at most MAX_SHARDS rows, so tasks hold it whole.
    """
    shards = manifest.select("path", "first_key", "last_key", "has_null").collect()
    ranges = [(r["first_key"], r["last_key"], i) for i, r in enumerate(shards) if r["first_key"] is not None]
    ranges.sort()
    lows, highs = [r[0] for r in ranges], [r[1] for r in ranges]
    nulls, paths = [i for i, r in enumerate(shards) if r["has_null"]], [r["path"] for r in shards]

    @F.pandas_udf("array<int>")
    def held(asked: pd.Series) -> pd.Series:
        # shards follow each other in key order, so both bounds rise
        return asked.map(lambda k: [ranges[i][2] for i in range(bisect.bisect_left(highs, k), bisect.bisect_right(lows, k))])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, now = None, None
        for batch in batches:
            for place, some in batch.groupby("shard", sort=False):
                if place != now:
                    fs, inner = open_fs(paths[place])
                    shard, now = Shard(fs, inner), place
                left, nth = some["doc_id"], 0
                while len(left):
                    present = left.notna().to_numpy()
                    ids = left.fillna(0).to_numpy(np.int64)
                    offsets, lengths = shard.find(ids, present, np.full(len(ids), nth))
                    hit = lengths >= 0
                    rows = [(k if p else None, paths[place], int(o), int(n), shard.read(o, n).tolist()) for k, p, o, n in zip(ids[hit].tolist(), present[hit], offsets[hit], lengths[hit])]
                    if rows:
                        yield pd.DataFrame(rows, columns=["doc_id", "path", "offset", "n_tokens", "ids"]).astype({"doc_id": "Int64"})
                    left, nth = left[hit], nth + 1

    asked = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    where = F.when(F.col("doc_id").isNull(), F.lit(nulls).cast("array<int>")).otherwise(held(F.coalesce("doc_id", F.lit(0))))
    placed = asked.select("doc_id", F.explode(where).alias("shard"))
    return placed.repartition("shard").sortWithinPartitions("shard").mapInPandas(read, "doc_id long, path string, offset long, n_tokens long, ids array<int>")


def read_store(manifest: DataFrame) -> DataFrame:
    """Every document of the store, found through the index: doc_id, start,
    n_tokens, ids_crc32 (of the ids as 32-bit little-endian integers), ids."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"]):
                fs, inner = open_fs(path)
                shard = Shard(fs, inner)
                offsets, lengths = shard.find(shard.ids, shard.present, shard.occurrence)
                if (lengths < 0).any():
                    raise ValueError(f"{path}: a key is missing from the index")
                for lo in range(0, shard.n, 1000):
                    rows = []
                    for i in range(lo, min(lo + 1000, shard.n)):
                        ids = shard.read(offsets[i], lengths[i])
                        rows.append((int(shard.ids[i]) if shard.present[i] else None, int(start + offsets[i]), len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    frame = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                    yield frame.astype({"doc_id": "Int64"})

    n = max(1, min(manifest.count(), 100_000))
    return manifest.select("path", "start").repartition(n).mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_store(spark, sf_dir: str) -> DataFrame:
    manifest = write_store(table(spark, sf_dir, "documents"), new_path(spark, "tokens"), tokenizer_path("byte_bpe_50k.json"))
    return read_store(manifest)


QUERIES = {"op5_token_store": op5_token_store}
SQL: dict[str, str] = {}
