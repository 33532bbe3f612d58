"""Near-duplicate documents by circulant MinHash, confirmed by exact Jaccard.

Signatures follow C-MinHash (Li and Li, 2021): one permutation scatters the shingle
hashes over a circle of 2**32 places, a second one, shifted by k places, gives the
k-th coordinate. Two permutations serve all 128 coordinates. Bands of ``ROWS``
coordinates are the candidate buckets; at a similarity of 0.75 a pair shares no
bucket with a probability of about 5e-6.

Copies with the same words collapse to one representative first. Buckets never give
all their pairs. In each round every representative is compared with a hub of its
buckets (in the first round with the one that shares most of them, then with the
others), comparisons are exact on the full shingle sets, and confirmed links
contract components. Texts in buckets that still hold several components are dealt
anew by an exact prefix filter over their shingles, rarest first. The rows of those
buckets meet in pairs of blocks of bounded size: a bucket of n rows sends n rows for
each BLOCK rows it holds, and only links leave a block. Nothing is capped.

Edge cases: texts with fewer than five words have their whole word sequence as one
shingle; texts without words (null, empty) have none and are linked with nothing;
rows that repeat a doc_id with different texts are documents of their own, which may lie in
different components; a null doc_id is its own component; texts of any length give all
their shingles (a block of texts holds at least one whole text); an empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType

from .common import cut, forget, free_name, table

SHINGLE = 5
COORDS, ROWS = 128, 4
BANDS = COORDS // ROWS
PERCENT = 75
BLOCK = 512  # rows of a bucket that are compared in one go
BLOCK_SHINGLES = 1 << 20  # and their shingles, as far as no single text has more
COLUMNS = 4096
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, mod 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        for i, b in enumerate((_BASE, _BASE_INV)):
            full = np.full(size, b, np.uint64)
            full[0] = 1
            _powers[i] = np.multiply.accumulate(full)
    return _powers[0][:n], _powers[1][:n]


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def normal_words(text: str | None) -> bytes:
    """The words, A-Z in lower case, joined by single spaces."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


@F.pandas_udf(BinaryType())
def packed(texts: pd.Series) -> pd.Series:
    """The words of each text, compressed: what travels when texts are compared."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    return texts.map(lambda text: squeeze(normal_words(text)))


def unpack_hashes(words: bytes) -> np.ndarray:
    return shingle_hashes(zstandard.decompress(words))


def shingle_hashes(words: bytes) -> np.ndarray:
    """Distinct 64-bit hashes of the five-word shingles, sorted.

    A shingle is a stretch of the normalised text, and its hash the polynomial of
    its bytes, from prefix sums mod 2**64, then mixed.
    """
    if not words:
        return np.empty(0, np.uint64)
    data = np.frombuffer(words, np.uint8)
    gaps = np.flatnonzero(data == 32)
    power, inverse = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
        starts = np.append(0, gaps + 1)
        ends = np.append(gaps, len(data))
        if len(starts) > SHINGLE - 1:
            starts, ends = starts[: len(starts) - SHINGLE + 1], ends[SHINGLE - 1:]
        else:
            starts, ends = starts[:1], ends[-1:]
        value = (sums[ends] - sums[starts]) * inverse[starts]
        return np.unique(_mix64(value ^ ((ends - starts).astype(np.uint64) << np.uint64(40))))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The COORDS circulant MinHash coordinates of a non-empty set."""
    with np.errstate(over="ignore"):
        place = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
        place = (place ^ (place >> np.uint32(16))) * np.uint32(0x7FEB352D)  # the first permutation
        place = (place ^ (place >> np.uint32(15))) * np.uint32(0x846CA68B)
        place ^= place >> np.uint32(16)
        out = np.full(COORDS, 0xFFFFFFFF, np.uint32)
        shifts = np.arange(COORDS, dtype=np.uint32)[:, None]
        for at in range(0, len(place), 2048):
            x = place[None, at:at + 2048] - shifts  # the second one, shifted along the circle
            x *= np.uint32(0x85EBCA6B)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0xC2B2AE35)
            x ^= x >> np.uint32(13)
            np.minimum(out, x.min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band."""
    with np.errstate(over="ignore"):
        key = np.arange(1, BANDS + 1, dtype=np.uint64) * _BASE
        for column in sig.reshape(BANDS, ROWS).T.astype(np.uint64):
            key = _mix64(key ^ column) * _BASE
    return key.view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, raw (hash of the text), n_shingles, content (hash of the word sequence;
    null without words) and bands (bucket keys) of every document."""

    @F.pandas_udf("n_shingles long, content binary, bands array<long>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            words = normal_words(text)
            hashes = shingle_hashes(words)
            rows.append((len(hashes), xxhash.xxh3_128_digest(words), band_keys(signature(hashes))) if len(hashes) else (0, None, None))
        return pd.DataFrame(rows, columns=["n_shingles", "content", "bands"])

    return docs.select("doc_id", F.xxhash64("text").alias("raw"), run("text").alias("__s")).select("doc_id", "raw", "__s.*")


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (u, v), those with an exact Jaccard of at least PERCENT / 100.

    Packed words (id, words) travel, not shingle sets: they are smaller. Each side is
    joined by its own key, so adaptive execution may split a popular hub.
    """
    left = texts.select(F.col("id").alias("u"), F.col("words").alias("__a"))
    right = texts.select(F.col("id").alias("v"), F.col("words").alias("__b"))

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out, known, last = [], None, None
        for x, y in zip(a, b):
            if last is None or y != last:
                known, last = unpack_hashes(y), y
            own = unpack_hashes(x)
            both = len(np.intersect1d(own, known, assume_unique=True))
            out.append(100 * both >= PERCENT * (len(own) + len(known) - both) and both > 0)
        return pd.Series(out, dtype=bool)

    return pairs.join(left, "u").join(right, "v").filter(linked("__a", "__b")).select(*pairs.columns)


def prefix_buckets(texts: DataFrame) -> DataFrame:
    """(key, id): buckets by the prefix filter, for texts (id, words).

    With any one order of all shingles, two sets with a Jaccard of at least t share a
    shingle among the first n - ceil(t * n) + 1 of each. In order of rising frequency
    those are the texts' own words, so a passage that many texts quote brings no two
    of them together unless they agree beyond it. The filter is exact.
    """

    @F.pandas_udf("array<long>")
    def hashes(words: pd.Series) -> pd.Series:
        return words.map(lambda x: unpack_hashes(x).view(np.int64))

    sets = texts.select("id", F.explode(hashes("words")).alias("s"))
    sets = cut(sets, "shingles")
    shared = cut(sets.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1"), "frequent")
    joined = sets.join(shared, "s", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    per_text = Window.partitionBy("id")
    ranked = joined.withColumn("r", F.row_number().over(per_text.orderBy("df", "s"))).withColumn("n", F.count("*").over(per_text))
    first = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    return ranked.filter((F.col("r") <= first) & (F.col("df") > 1)).select(F.col("s").alias("key"), "id")


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of every id on an edge (u, v): the smallest id reachable.

    Rounds of hooking each component to its smallest neighbour and of pointer
    jumping, on tables of ids only.
    """
    edges = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = cut(edges, "edges")
    labels = cut(now.select(F.col("u").alias("id")).union(now.select(F.col("v").alias("id"))).distinct().select("id", F.col("id").alias("comp")), "labels")
    while not now.isEmpty():
        jumped = cut(now.groupBy("u").agg(F.min("v").alias("p"), F.lit(True).alias("moved")), "parents")
        while True:  # pointer jumping; parents are always smaller, so this ends
            parent, last = jumped.select("u", "p"), jumped
            up = parent.select(F.col("u").alias("__u"), F.col("p").alias("__p"))
            jumped = cut(parent.join(up, F.col("p") == F.col("__u"), "left").select("u", F.coalesce("__p", "p").alias("p"), F.col("__p").isNotNull().alias("moved")), "jumped")
            forget(last)
            if jumped.filter("moved").isEmpty():
                break
        parent, old, edges = jumped.select("u", "p"), labels, now
        labels = cut(labels.join(parent, labels["comp"] == parent["u"], "left").select("id", F.coalesce("p", "comp").alias("comp")), "labels")
        a, b = parent.select(F.col("u").alias("__a"), F.col("p").alias("__pa")), parent.select(F.col("u").alias("__b"), F.col("p").alias("__pb"))
        moved = now.join(a, now["u"] == a["__a"], "left").join(b, now["v"] == b["__b"], "left").select(F.coalesce("__pa", "u").alias("u"), F.coalesce("__pb", "v").alias("v"))
        now = cut(moved.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        forget(old, edges, jumped)
    forget(now)
    return labels


def _with_comp(rows: DataFrame, labels: DataFrame | None, id_col: str, out: str) -> DataFrame:
    if labels is None:
        return rows.withColumn(out, F.col(id_col))
    named = labels.select(F.col("id").alias("__id"), F.col("comp").alias("__comp"))
    return rows.join(named, rows[id_col] == named["__id"], "left").withColumn(out, F.coalesce("__comp", id_col)).drop("__id", "__comp")


def link(reps: DataFrame, docs: DataFrame) -> DataFrame | None:
    """Components (id, comp) of the representatives (id, doc_id, raw, n_shingles, bands);
    None: no links."""
    buckets = reps.select("id", F.explode("bands").alias("key"))
    hubs = buckets.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("key", "hub")
    hubs = cut(hubs, "hubs")
    shared = cut(buckets.join(hubs, "key"), "buckets")  # only buckets of several rows
    forget(hubs)
    if shared.isEmpty():
        return None
    needed = reps.join(shared.select("id").distinct(), "id", "left_semi").select("id", F.col("doc_id").alias("__doc"), F.col("raw").alias("__raw"))
    # An inner join, as Spark would move a semi join below the packing.
    own = docs.select("doc_id", F.xxhash64("text").alias("raw"), packed("text").alias("words"))
    met = own.join(needed, (own["doc_id"] == needed["__doc"]) & (own["raw"] == needed["__raw"]))
    # duplicates go by the join's keys as well, so that nothing is exchanged again
    texts = cut(met.select("doc_id", own["raw"], "id", "words").dropDuplicates(["doc_id", "raw", "id"]).select("id", "words"), "texts")

    star = shared.filter("id != hub").groupBy(F.col("id").alias("u"), F.col("hub").alias("v")).agg(F.count("*").alias("w"))
    star = cut(star, "star")
    best = cut(star.groupBy("u").agg(F.max_by("v", F.struct("w", -F.col("v"))).alias("v")), "best")
    links = cut(confirm(best, texts), "links")
    labels = None if links.isEmpty() else components(links)
    labels = _compare(star.select("u", "v").join(best, ["u", "v"], "left_anti"), labels, texts)
    forget(star, best, links)

    several = _mixed(shared, labels)
    forget(shared)
    if several.isEmpty():
        return labels
    members = several.select(F.col("id").alias("__id")).distinct()
    shared = cut(prefix_buckets(texts.join(members, texts["id"] == members["__id"], "left_semi").select("id", "words")), "prefixes")
    forget(several)
    several = _mixed(shared, labels)
    forget(shared)
    if several.isEmpty():
        return labels
    sizes = reps.select("id", "n_shingles")
    links = cut(match_blocks(deal(several.join(sizes, "id")), texts), "links")
    merged = _merge(labels, links)
    forget(several, links, texts)
    return merged


def deal(several: DataFrame) -> DataFrame:
    """(key, lo, hi, side, id, comp): the rows of each bucket (key, id, comp, n_shingles)
    dealt to pairs of blocks, so that any two rows of a bucket meet in one pair of blocks.

    A bucket has b blocks, enough for BLOCK rows and BLOCK_SHINGLES shingles in each, and
    gives its rows b times, never its pairs. Of buckets with the same members (equal
    counts and hashes) one is kept.
    """
    size = several.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"), F.bit_xor(F.xxhash64("id")).alias("h1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("h2"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.least(F.ceil(F.col("s") / BLOCK_SHINGLES), F.col("n"))).cast("int")
    size = cut(size.groupBy("n", "s", "h1", "h2").agg(F.min("key").alias("key")).select("key", blocks.alias("b")), "sizes")
    own = several.join(size, "key").withColumn("side", F.pmod(F.xxhash64("id", F.lit(2)), F.col("b")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    return met.select("key", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "id", "comp")


def match_blocks(dealt: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v): linked components, as a spanning forest for each pair of blocks, by
    exact Jaccard of every two rows of different components."""

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [unpack_hashes(w) for w in rows["words"]]
        sizes = np.array([len(x) for x in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, place, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.cumsum(df > 1) - 1  # columns of shingles that several rows hold
        owner, column = owner[df[place] > 1], rank[place[df[place] > 1]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        whole = rows["lo"].iat[0] == rows["hi"].iat[0]
        left = np.flatnonzero(rows["side"] == rows["lo"])
        right = left if whole else np.flatnonzero(rows["side"] == rows["hi"])
        both = np.zeros((len(left), len(right)), np.int64)
        for start in range(0, int(rank[-1]) + 1, COLUMNS):
            lo, hi = np.searchsorted(column, [start, start + COLUMNS])
            held = np.zeros((len(sets), COLUMNS), np.float32)
            held[owner[lo:hi], column[lo:hi] - start] = 1
            both += (held[left] @ held[right].T).astype(np.int64)
        comp = rows["comp"].to_numpy()
        linked = (100 * both >= PERCENT * (sizes[left][:, None] + sizes[right][None, :] - both)) & (comp[left][:, None] != comp[right][None, :])
        a, b = np.nonzero(linked)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        out = []
        for u, v in zip(comp[left[a]].tolist(), comp[right[b]].tolist()):
            ru, rv = root(u), root(v)
            if ru != rv:
                parent[max(ru, rv)] = min(ru, rv)
                out.append((u, v))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    kind = dict(dealt.dtypes)["comp"]
    named = texts.select(F.col("id").alias("__id"), "words")
    met = dealt.join(named, dealt["id"] == named["__id"]).drop("__id")
    return met.groupBy("key", "lo", "hi").applyInPandas(match, f"u {kind}, v {kind}")


def _mixed(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(key, id, comp) of buckets that hold more than one component."""
    own = cut(_with_comp(shared.select("key", "id"), labels, "id", "comp"), "members")
    mixed = own.groupBy("key").agg(F.min("comp").alias("__lo"), F.max("comp").alias("__hi")).filter("__lo != __hi").select("key")
    mixed = cut(mixed, "mixed")
    several = cut(own.join(mixed, "key", "left_semi"), "several")
    forget(own, mixed)
    return several


def _compare(pairs: DataFrame, labels: DataFrame | None, texts: DataFrame) -> DataFrame | None:
    """The labels after the confirmed ones of the pairs (u, v) between different
    components."""
    pairs = _with_comp(_with_comp(pairs, labels, "u", "__cu"), labels, "v", "__cv").filter("__cu != __cv")
    pairs = cut(pairs, "pairs")
    if not pairs.isEmpty():
        more = cut(confirm(pairs, texts).select(F.col("__cu").alias("u"), F.col("__cv").alias("v")), "links")
        labels = _merge(labels, more)
        forget(more)
    forget(pairs)
    return labels


def _merge(labels: DataFrame | None, more: DataFrame) -> DataFrame | None:
    """The labels after the components (u, v) are joined; only those are worked on."""
    if more.isEmpty():
        return labels
    merged = components(more.distinct())
    if labels is None:
        return merged
    old = merged.select(F.col("id").alias("__old"), F.col("comp").alias("__new"))
    known = labels.select(F.col("id").alias("__known"))
    moved = labels.join(old, labels["comp"] == old["__old"], "left").select("id", F.coalesce("__new", "comp").alias("comp"))
    added = merged.join(known, merged["id"] == known["__known"], "left_anti")
    done = cut(moved.unionByName(added), "labels")
    forget(labels, merged)
    return done


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    rows = cut(sketch(docs), "sketches")
    named = rows.filter("content is not null and doc_id is not null")
    copies = named.groupBy("content").agg(F.min(F.struct("doc_id", "raw")).alias("first")).select("content", "first.*")
    copies = cut(copies.orderBy("doc_id", "content").withColumn("id", F.monotonically_increasing_id()), "copies")
    # the bands of each representative, from a row that its number was taken from
    firsts = copies.select("content", "doc_id", "raw", "id")
    reps = named.join(firsts, ["content", "doc_id", "raw"]).dropDuplicates(["content", "doc_id", "raw"]).select("id", "doc_id", "raw", "n_shingles", "bands")
    reps = cut(reps, "reps")
    labels = link(reps, docs)
    forget(reps)
    least = copies.select(F.col("id").alias("__comp"), F.col("doc_id").alias("component_id"))
    named = _with_comp(copies.select("content", "id"), labels, "id", "comp")
    classes = cut(named.join(least, named["comp"] == least["__comp"]).select(F.col("content").alias("__c"), "component_id"), "classes")
    forget(copies, labels)
    out = rows.select("doc_id", "n_shingles", "content").join(classes, F.col("content") == F.col("__c"), "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, the one with the smallest id, with all columns.

    Rows of one id and one text are one document; different texts under one id are
    different documents, compared and kept by numbers of their own in order of the
    ids. Rows without an id stay.
    """
    ids = docs.select("doc_id").filter("doc_id is not null")
    if ids.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return _keep_one(docs, "doc_id")
    key = free_name(docs, "__key")
    named = docs.filter("doc_id is not null").dropDuplicates(["doc_id", "text"])
    ordered = named.orderBy("doc_id", F.xxhash64("text")).withColumn(key, F.monotonically_increasing_id())
    kept = _keep_one(cut(ordered, "keyed"), key).drop(key)
    return docs.filter("doc_id is null").unionByName(kept)


def _keep_one(docs: DataFrame, key: str) -> DataFrame:
    """Like keep_one, by a column that is null or different in each row."""
    result = near_duplicates(docs.select(F.col(key).alias("doc_id"), "text"))
    gone = free_name(docs, "__gone")
    dropped = cut(result.filter(~F.col("kept")).select(F.col("doc_id").alias(gone)), "dropped")
    return docs.join(dropped, docs[key] == dropped[gone], "left_anti")


def op2_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op2_neardup": op2_neardup}
SQL = {
    "op2_neardup": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
),
g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS s FROM w
),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM g),
e AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
),
r AS (SELECT doc_id, doc_id AS c FROM g UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.doc_id)
SELECT g.doc_id, cast(len(g.s) AS BIGINT) AS n_shingles, min(r.c) AS component_id, g.doc_id = min(r.c) AS kept
FROM g JOIN r ON g.doc_id = r.doc_id GROUP BY g.doc_id, len(g.s)
"""
}
