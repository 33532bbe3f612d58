"""Secret scans: fixed patterns, and guess costs of values in a credential context.

Base spans come from three patterns. The method then looks at every value that
stands behind a credential word and prices it: dynamic programming finds the
cheapest way to cut the value into dictionary words, dates, repeats, keyboard walks
and brute-force spans, in log2 guesses. A value that stays expensive is a secret of
the kind ``guess``, whatever its alphabet; a cheap one (a placeholder, a word, a
date) is not added. Base spans always stay.

The minimum is over all segmentations, with these prices (each segment adds
SEGMENT_BITS): a word costs the log2 of its rank, more with odd capitals or signs for
letters; a date by its layout; a repeat costs its unit (priced the same way) and the log2
of its count; a walk along a row or column of keys or the alphabet costs the choice of its
start and the log2 of its length; brute force costs each character by its alphabet. Words,
dates and walks have bounded length; repeats of any count come from the maximal runs of
the value, and of the starts for one unit only those are kept that can still win. Units have
any length and rotation. Those of over MAX_UNIT characters are priced, but for the rotation with
which the run begins, only where bounds from other covers leave open that they win with less than
DEAR bits: prices below DEAR are exact, and so is every verdict, as none needs more than PROSE_BITS.
A price above DEAR is that of a real segmentation, perhaps not the cheapest.

A context is a credential word, a separator (with any white space and at most one line
break on either side), perhaps a scheme such as Bearer or one more credential word, and the
value up to white space, a quote or the next context. Of a URL only the parts behind the
host, and what stands before an @, are priced, each by itself; the dearest one counts.

Words come from a public vocabulary, in its order. A value of letters alone in ordinary
capitals whose pairs of letters are those of words may be prose in a language that the
vocabulary lacks: there PROSE_BITS decide.

Edge cases: null and empty texts have no spans; texts and values of any length are
read whole; rows that repeat each get a result; an empty table gives no rows; spans are
half-open and count code points; equal starts order by kind as assign, access, hex,
guess; a guess span that a base assign span already covers is not repeated. Other
columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import json
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .bpe import tokenizer_path
from .common import table

KINDS = ("assign", "access", "hex", "guess")
# The base patterns are fixed by the query's contract. Letters of the assign key
# match in either case; ASCII mode keeps look-alikes of other alphabets out.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
_CREDENTIAL = r"(?:password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|access[_-]?key|auth(?:orization)?|credentials?)"
_BREAK = r"[^\S\n]*+(?:\n[^\S\n]*+)?+"
_IS = r"(?:[:=]|=>|\bis\b)"
#: a credential word, a separator, and a scheme or a bare credential word; the value follows
CONTEXT = re.compile(rf"""(?ai){_CREDENTIAL}["']?+{_BREAK}{_IS}>?+{_BREAK}["']?+(?:(?:bearer|basic|digest|{_CREDENTIAL})[^\S\n]++(?!{_IS}))?+""")
_VALUE_END = re.compile(r"""[\s"'<>]""")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*+://")
_URL_PARTS = re.compile(r"[/?&=#.:;,@+_%~-]+")
MIN_VALUE = 8
MIN_BITS = 40.0
PROSE_BITS = 90.0
VOCABULARY = "word_bpe_49k.json"

#: common password and placeholder words, most frequent first; they come before the vocabulary
WORDS = (
    "password pass admin user root test guest login welcome letmein secret token key default example sample demo "
    "change changeme none null true false your my the here value string hidden redacted dummy placeholder fake "
    "qwerty dragon monkey football baseball master shadow sunshine princess superman batman hello freedom whatever "
    "love iloveyou summer winter spring autumn"
).split()
#: keys that lie in a line: rows, columns (both ways they lean), digits and the alphabet
LINES = (
    "`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "qwertzuiop", "azertyuiop", "abcdefghijklmnopqrstuvwxyz", "0123456789",
    "1qaz", "2wsx", "3edc", "4rfv", "5tgb", "6yhn", "7ujm", "8ik,", "9ol.", "0p;/", "4esz", "5rdx", "6tfc", "7ygv", "8uhb", "9ijn", "0okm",
)
SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
LEET = str.maketrans("4@301!5$7+", "aaeoiisstt")
SEGMENT_BITS = 1.0
MIN_RUN = 3  # characters of the shortest word, walk or repeat
FEW, PAIRS = 400, 1 << 20  # characters of a short value; pairs that are compared at once
MAX_UNIT, DEAR, COVERS = 64, 256.0, 16
WALK_BITS = math.log2(2 * sum(map(len, LINES)))
DATES = tuple(
    (re.compile(p), math.log2(n))
    for p, n in (
        (r"(?:19|20)\d\d", 200.0),
        (r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])", 73_000.0),
        (r"(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\1(?:19|20)\d\d", 73_000.0),
        (r"(?:0[1-9]|1[0-2])([-/._]?)(?:0[1-9]|[12]\d|3[01])\1(?:19|20)\d\d", 73_000.0),
        (r"\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])", 36_500.0),
        (r"(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\1\d\d", 36_500.0),
        (r"(?:0[1-9]|1[0-2])([-/._]?)(?:0[1-9]|[12]\d|3[01])\1\d\d", 36_500.0),
    )
)
#: (key, next key) -> the lines and directions in which they follow each other
_STEPS: dict[tuple[str, str], set[int]] = {}
for _n, _line in enumerate(LINES):
    for _way, _run in ((2 * _n, _line), (2 * _n + 1, _line[::-1])):
        for _pair in zip(_run, _run[1:]):
            _STEPS.setdefault(_pair, set()).add(_way)


class Words(dict):
    """Guess rank of each word; ``longest`` bounds the length of a word."""

    def __init__(self, words):
        super().__init__()
        for w in words:
            self.setdefault(w, len(self) + 1)
        self.longest = max(map(len, self), default=0)
        pairs: dict[str, int] = {}
        for w in self:
            for pair in map("".join, zip(" " + w, w)):
                pairs[pair] = pairs.get(pair, 0) + 1
        firsts: dict[str, int] = {}
        for pair, n in pairs.items():
            firsts[pair[0]] = firsts.get(pair[0], 0) + n
        self.pair_bits = {pair: math.log2((firsts[pair[0]] + 13) / (n + 0.5)) for pair, n in pairs.items()}
        self.first_bits = {c: math.log2((n + 13) / 0.5) for c, n in firsts.items()}

    def letter_bits(self, value: str) -> float:
        """Mean log2 price of a letter of ``value`` behind the one before it, as in the words; marks on letters are left out."""
        plain = "".join(c for c in unicodedata.normalize("NFD", value.lower()) if c.isalpha())
        steps = [self.pair_bits.get(a + b, self.first_bits.get(a, 5.0)) for a, b in zip(" " + plain, plain)]
        return sum(steps) / max(1, len(steps))


COMMON = Words(WORDS)


@functools.lru_cache(maxsize=2)
def load_words(path: str | None) -> Words:
    """The common words and then the whole words of a vocabulary file, in its order."""
    if path is None:
        return COMMON
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    ends = (t[:-4] for t in sorted(vocabulary, key=vocabulary.get) if t.endswith("</w>"))
    return Words([*WORDS, *(w for w in ends if len(w) >= MIN_RUN and w.isascii() and w.isalpha())])


def char_bits(c: str) -> float:
    """log2 of the size of the alphabet that c belongs to."""
    if c.isdigit():
        return math.log2(10)
    if c.isascii() and c.isalpha():
        return math.log2(26)
    return math.log2(33) if c.isascii() else math.log2(100)


def word_bits(word: str, lower: str, words: Words) -> float | None:
    """Price of a word whose lower case is ``lower``; None if it is unknown."""
    rank, extra = words.get(lower), 0.0
    if rank is None:
        rank, extra = words.get(lower.translate(LEET)), 2.0
    if rank is None:
        return None
    return math.log2(rank + 1) + extra + (0.0 if word.islower() else 1.0 if word.istitle() or word.isupper() else 3.0)


def runs_of(value: str) -> list[tuple[int, int, int]]:
    """(unit length, start, end) of the maximal runs: stretches of two units at least, of a unit that is no repeat itself."""
    codes = np.array([ord(c) for c in value], np.int32)
    return long_runs(codes) if len(codes) > FEW else few_runs(codes, value)


def few_runs(codes: np.ndarray, value: str) -> list[tuple[int, int, int]]:
    """``runs_of`` by trying every unit length at every place; least work for short values."""
    n, found = len(codes), []
    for u in range(1, n // 2 + 1):
        breaks = np.flatnonzero(codes[u:] != codes[:-u])
        if len(breaks) > (n - u) - u:
            continue  # too few equal characters for one run
        edges = np.concatenate(([-1], breaks, [n - u]))
        for k in np.flatnonzero(np.diff(edges) > u).tolist():
            start, end = int(edges[k]) + 1, int(edges[k + 1]) + u
            unit = value[start:start + u]
            if (unit + unit).find(unit, 1) == u:
                found.append((u, start, end))
    return found


def long_runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """``runs_of`` for values of any length: a run of unit length u holds a multiple p of u with p + u,
    so it is found from the equal stretches around these two; n log n pairs for all u."""
    n = len(codes)
    names = [np.unique(codes, return_inverse=True)[1].astype(np.int32)]  # names[k][p]: which stretch of 2 ** k characters is at p
    while 2 << (len(names) - 1) <= n and names[-1].max() + 1 < len(names[-1]):
        half = 1 << (len(names) - 1)
        names.append(np.unique(names[-1][:-half].astype(np.int64) << 32 | names[-1][half:], return_inverse=True)[1].astype(np.int32))
    known: list[np.ndarray] = []
    u = 1
    while u <= n // 2:
        beyond = min(n // 2 + 1, u + max(1, PAIRS * u // n))
        lengths = np.arange(u, beyond)
        counts = (n - 1) // lengths  # multiples p of u with p + u < n
        unit = np.repeat(lengths, counts)
        p = (np.arange(len(unit)) - np.repeat(np.cumsum(counts) - counts, counts)) * unit
        ahead, behind = np.zeros_like(p), np.zeros_like(p)  # equal characters from p and p + u on, and before them
        for k in range(len(names) - 1, -1, -1):
            size, last = 1 << k, len(names[k]) - 1
            a = p + ahead
            b = a + unit
            ahead += size * ((b <= last) & (names[k][np.minimum(a, last)] == names[k][np.minimum(b, last)]))
            a = p - behind - size
            b = a + unit
            behind += size * ((a >= 0) & (names[k][np.clip(a, 0, last)] == names[k][np.clip(b, 0, last)]))
        whole = ahead + behind >= unit
        rows = np.stack([p - behind, p + unit + ahead, unit])[:, whole]
        _, first = np.unique(rows[0] * (n + 1) + rows[1], return_index=True)  # the shortest unit of a stretch is no repeat
        known.append(rows[:, np.sort(first)])
        u = beyond
    start, end, unit = np.concatenate(known, axis=1)
    _, first = np.unique(start * (n + 1) + end, return_index=True)
    return sorted(zip(unit[first].tolist(), start[first].tolist(), end[first].tolist()))


def guess_bits(value: str, words: Words = COMMON) -> float:
    """log2 guesses of the cheapest segmentation of ``value``."""
    return guess_costs(value, words)[-1]


def guess_costs(value: str, words: Words = COMMON) -> list[float]:
    """``guess_bits`` of the first 0, 1, ... characters of ``value``."""
    n = len(value)
    lower = value.lower()
    alike = len(lower) == n
    if not alike:  # a letter whose lower case is longer: compare as written
        lower = value
    keys = lower.translate(SHIFTED)
    shifted = [0]  # how many of the first i keys needed a shift
    for c, k in zip(value, keys):
        shifted.append(shifted[-1] + (c != k))
    bits = [char_bits(c) for c in value]
    best = [0.0] + [math.inf] * n  # cheapest cover of the first i characters
    by_run: dict[int, set] = {}  # runs whose repeats reach that price
    brute = math.inf  # the same, ending inside a brute-force span
    ways: dict[int, int] = {}  # line and direction -> where the walk that goes on along it began
    units: dict[object, float] = {}
    opening: dict[int, list[tuple[int, int, int]]] = {}
    for run in runs_of(value) if n >= MIN_RUN else ():
        opens = run[1] + max(2, -(-MIN_RUN // run[0])) * run[0]
        if opens <= run[2]:
            opening.setdefault(opens, []).append(run)
    running: list[tuple[int, int, int]] = []
    covers: dict[tuple[int, int], list[tuple[int, list[float]]]] = {}  # unit length, run -> places in it and the costs from there on
    starts: dict[tuple[int, int, int], list[int]] = {}  # unit length, run, rotation -> the starts that can still win

    for i in range(n):
        here = best[i]
        brute = min(brute, here + SEGMENT_BITS) + bits[i]
        cost = brute
        # segments that begin here
        if lower[i].isalpha() or lower[i:i + 1].translate(LEET).isalpha():
            for j in range(MIN_RUN, min(words.longest, n - i) + 1):
                price = word_bits(value[i:i + j], lower[i:i + j], words)
                if price is not None and here + price + SEGMENT_BITS < best[i + j]:
                    best[i + j] = here + price + SEGMENT_BITS
        if value[i].isdigit():
            for pattern, price in DATES:
                found = pattern.match(value, i)
                if found and here + price + SEGMENT_BITS < best[found.end()]:
                    best[found.end()] = here + price + SEGMENT_BITS
        # segments that end behind this character
        steps = _STEPS.get((keys[i - 1], keys[i]), ()) if i else ()
        ways = {w: ways.get(w, i - 1) for w in steps}
        for began in ways.values():
            for start in range(began, i + 2 - MIN_RUN):
                extra = 2.0 if shifted[i + 1] > shifted[start] else 0.0
                price = best[start] + WALK_BITS + extra + math.log2(i + 1 - start) + SEGMENT_BITS
                if price < cost:
                    cost = price
        cost = min(cost, best[i + 1])
        if running or i + 1 in opening:
            running = [r for r in running if r[2] > i]
            if i + 1 in opening:
                running = sorted(running + opening[i + 1])  # short units first: their prices spare long ones
        for run in running:
            u, begun, _ = run
            rotation = (i + 1 - begun) % u
            open_at = starts.setdefault((u, begun, rotation), [])
            start = i + 1 - max(2, -(-MIN_RUN // u)) * u
            # a start that a repeat of this run reached loses to that repeat's own start, and a dearer one to a later start
            if run not in by_run.get(start, ()):
                while open_at and best[open_at[-1]] >= best[start]:
                    open_at.pop()
                open_at.append(start)
            unit: object = (u, begun, rotation)
            if u <= MAX_UNIT or not rotation:
                unit = value[i + 1 - u:i + 1]
            elif unit not in units and alike:
                # least price of the unit, from covers that begin before it; a start and its unit cost no less than the cover up to their end
                at, behind = begun + rotation, covers.setdefault((u, begun), [])
                least = max((min(c[at + u - q], DEAR) - c[at - q] for q, c in behind if q <= at < q + u), default=0.0)
                tried = (max(best[s] + least, best[s + u]) + math.log2((i + 1 - s) // u) for s in open_at)
                if min(tried, default=math.inf) + SEGMENT_BITS >= min(cost, DEAR) - 1e-9:
                    continue
                behind.append((at, guess_costs(value[at:min(at + 2 * u - 1, run[2])], words)))
                units[unit] = behind[-1][1][u]
                del behind[:-COVERS]
            if unit not in units:
                units[unit] = bits[i] if u == 1 else guess_bits(value[i + 1 - u:i + 1], words)
            for start in open_at:
                price = best[start] + units[unit] + math.log2((i + 1 - start) // u) + SEGMENT_BITS
                if price < cost:
                    cost, by_run[i + 1] = price, {run}
                elif price == cost:
                    by_run.setdefault(i + 1, set()).add(run)
        best[i + 1] = cost
    return best


def value_bits(value: str, words: Words = COMMON) -> float:
    """``guess_bits`` of a value; of a URL the dearest part besides scheme and host."""
    url = _URL.match(value)
    if not url:
        return guess_bits(value, words)
    rest = value[url.end():]
    authority, slash, path = rest.partition("/")
    user, at, _ = authority.rpartition("@")
    return max(guess_bits(part, words) for part in [*(user.split(":") if at else ()), *_URL_PARTS.split(path)] or [""])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def is_prose(value: str, words: Words) -> bool:
    """Letters alone, in the capitals of running text, whose pairs are no dearer than letters at random."""
    return value.isalpha() and (value.islower() or value.istitle() or value.isupper()) and words.letter_bits(value) < math.log2(26)


def context_values(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the value of every credential context that has one."""
    contexts = list(CONTEXT.finditer(text))
    for m, following in zip(contexts, [*contexts[1:], None]):
        start = m.end()
        end = _VALUE_END.search(text, start, following.start() if following else len(text))
        end = end.start() if end else following.start() if following else len(text)
        value = text[start:end].rstrip(".,;:!?)]}&")
        if value:
            yield start, start + len(value)


def priced_values(text: str, words: Words = COMMON) -> list[tuple[int, int, float, bool]]:
    """(start, end, bits, is a secret) of every value in a credential context."""
    found = []
    for start, end in context_values(text):
        value = text[start:end]
        bits = value_bits(value, words)
        needed = PROSE_BITS if is_prose(value, words) else MIN_BITS
        found.append((start, end, bits, len(value) >= MIN_VALUE and bits >= needed))
    return found


def guess_spans(base: list[tuple[int, int, int]], priced: list[tuple[int, int, float, bool]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the secrets among the values that no base span covers.
    Base spans of one kind don't overlap, so the last to start at or before a value is
    the one that may cover it."""
    assigned = [(s, e) for s, k, e in base if k == 0]
    starts = [s for s, _ in assigned]
    out = []
    for start, end, _, secret in priced:
        at = bisect.bisect_right(starts, start) - 1
        if secret and not (at >= 0 and assigned[at][1] >= end):
            out.append((start, 3, end))
    return out


def find_secrets(text: str | None, words: Words = COMMON) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], list[tuple[int, int, float, bool]]]:
    """(base spans, all spans, priced values) of a text."""
    if not text:
        return [], [], []
    base, priced = base_spans(text), priced_values(text, words)
    return base, sorted(base + guess_spans(base, priced)), priced


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per document: counts, digest and list of its spans, and ``values``, the
    price of every value in a credential context as start:end:bits."""

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, values string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = load_words(vocabulary)
        for texts in batches:
            rows = []
            for text in texts:
                base, every, priced = find_secrets(text, words)
                kinds = [k for _, k, _ in base]
                values = ",".join(f"{s}:{e}:{bits:.2f}" for s, e, bits, _ in priced)
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(every), values))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "values"])

    return docs.select("doc_id", found("text").alias("__s")).select("doc_id", "__s.*")


def redact_text(text: str | None, words: Words = COMMON, mark: str = "[SECRET]") -> str | None:
    """``text`` with every secret replaced by ``mark``; overlapping spans merge."""
    if not text:
        return text
    out, at = [], 0
    for start, _, end in find_secrets(text, words)[1]:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The documents with their secrets replaced; n_chars follows the text."""

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = load_words(vocabulary)
        for texts in batches:
            yield texts.map(lambda t: redact_text(t, words))

    cols = [clean(docs["text"]).alias("text") if c == "text" else docs[c] for c in docs.columns]
    done = docs.select(*cols)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))
    return done


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY))


QUERIES = {"op1_secrets": op1_secrets}
SQL: dict[str, str] = {}
