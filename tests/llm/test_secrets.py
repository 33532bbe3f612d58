"""Secret scans against brute force: spans, prices, and what must be left alone."""

import functools
import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import secrets
from tessera.llm.bpe import tokenizer_path

from .test_llm import DOCS, prose

PATH = tokenizer_path(secrets.VOCABULARY)


def brute_bits(value, words):
    """The cheapest segmentation by trying every segment of every kind."""
    lower = value.lower() if len(value.lower()) == len(value) else value
    keys = lower.translate(secrets.SHIFTED)

    @functools.lru_cache(maxsize=None)
    def segment(s, e):
        part, n = value[s:e], e - s
        prices = [sum(map(secrets.char_bits, part))]
        if secrets.MIN_RUN <= n <= words.longest:
            price = secrets.word_bits(part, lower[s:e], words)
            prices += [] if price is None else [price]
        prices += [p for pattern, p in secrets.DATES if pattern.fullmatch(part)]
        for u in range(1, n // 2 + 1):
            if n % u == 0 and n >= secrets.MIN_RUN and part[:u] * (n // u) == part:
                prices.append((secrets.char_bits(part[0]) if u == 1 else brute_bits(part[:u], words)) + math.log2(n // u))
        if n >= secrets.MIN_RUN and any(keys[s:e] in line or keys[s:e] in line[::-1] for line in secrets.LINES):
            prices.append(secrets.WALK_BITS + math.log2(n) + (2.0 if keys[s:e] != part else 0.0))
        return min(prices) + secrets.SEGMENT_BITS

    best = [0.0]
    for e in range(1, len(value) + 1):
        best.append(min(best[s] + segment(s, e) for s in range(e)))
    return best[-1]


@pytest.mark.parametrize("vocabulary", [None, PATH])
def test_the_price_is_the_least_of_all_segmentations(vocabulary):
    words, rng = secrets.load_words(vocabulary), random.Random(11)
    parts = ["password", "Monkey", "p4$$word", "2019-12-31", "12/31/1999", "311299", "1qaz", "2wsx", "qwerty", "lkj", "!QAZ", "aaaa", "abcabc", "xyxyxy", "Zq8#", "é", "1", "dragon", "9", "Z"]
    values = ["passworddddd", "tokenopqrst", "monkeyyyyyyyyy", "2019-12-31111111", "1qaz2wsx3edc", "abcabcabcabc", "dragondragondragon", "", "a" * 70, "ab" * 40, "İstanbul1111"]
    values += ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(120)]
    values += ["".join(rng.choices("ab1", k=rng.randint(1, 20))) for _ in range(120)]
    for v in values:
        assert secrets.guess_bits(v, words) == pytest.approx(brute_bits(v, words)), v


def test_repeats_of_any_length():
    assert secrets.guess_bits("*" * 200) < secrets.guess_bits("*" * 64) + 2 < 16
    assert secrets.guess_bits("a" * 50_000) < 25 and secrets.guess_bits("Xv9" * 20_000) < 45
    assert secrets.guess_bits("abcdefghijklmnopq" * 3) < 22
    unit = "correct-horse-9#Kq-" * 1 + "z!" * 40
    assert secrets.guess_bits(unit * 3) < secrets.guess_bits(unit) + 4
    for t in ("password=" + "*" * 200, "token: " + "x" * 5_000):
        assert secrets.priced_values(t)[0][3] is False


def test_repeats_against_brute_force():
    rng = random.Random(9)
    for _ in range(60):
        unit = "".join(rng.choices("aab#9Zq", k=rng.randint(1, 24)))
        v = rng.choice(["", "x", "ab", "9Z"]) + unit * rng.randint(2, 5) + rng.choice(["", unit[:3], "pass"])
        assert secrets.guess_bits(v) == pytest.approx(brute_bits(v, secrets.COMMON)), v


def test_repeats_of_long_units_in_long_values():
    unit = "a" * 1_500 + "b" * 1_500
    assert secrets.guess_bits(unit * 2) < 36 and secrets.guess_bits(unit * 3) < 37  # 6,000 and 9,000 characters
    assert secrets.priced_values("token: " + unit * 2)[0][3] is False
    began = time.time()
    secrets.guess_bits(("".join(random.Random(2).choices("abcdefgh0123", k=20_000)) * 3)[:50_000])
    secrets.guess_bits(("a" * 5_000 + "b" * 5_000) * 3)
    assert time.time() - began < 60


def test_runs_of_long_values():
    rng = random.Random(6)
    for n in range(80):
        unit = "".join(rng.choices("abc"[: 2 + n % 2], k=rng.randint(1, 30)))
        value = "".join(rng.choices(["a", "b", unit, unit[:5]], k=rng.randint(3, 12)))
        codes = np.array([ord(c) for c in value], np.int32)
        runs = sorted((u, s, e) for u in range(1, len(value) // 2 + 1) for s in range(len(value) - 2 * u + 1) for e in [next((k for k in range(s + u, len(value)) if value[k] != value[k - u]), len(value))]
                      if e - s >= 2 * u and (not s or value[s - 1] != value[s - 1 + u]) and not any(value[s:s + u] == value[s:s + d] * (u // d) for d in range(1, u) if u % d == 0))
        assert secrets.long_runs(codes) == runs == sorted(secrets.few_runs(codes, value)) if len(value) > 1 else True


def test_every_rotation_of_a_long_unit(monkeypatch):
    rng, values = random.Random(8), ["onkey2019" + "a" * 60 + "b" * 60 + ("monkey2019" + "a" * 60 + "b" * 60) * 3]
    for _ in range(60):
        unit = "".join(rng.choices(["password", "Monkey", "2019", "aaaaaaa", "bbbbbbbbbb", "q", "Zq"], k=rng.randint(2, 6)))
        values.append(rng.choice(["", "x", "ssword"]) + unit * rng.randint(2, 3) + unit[: rng.randint(0, len(unit))])
    monkeypatch.setattr(secrets, "MAX_UNIT", 4)
    got = [secrets.guess_bits(v) for v in values]
    monkeypatch.setattr(secrets, "MAX_UNIT", 10**6)  # every rotation priced
    want = [secrets.guess_bits(v) for v in values]
    for v, g, w in zip(values, got, want):
        assert g == pytest.approx(w) if w < secrets.DEAR else g >= w - 1e-6, v


def test_contexts():
    words = secrets.load_words(PATH)
    strong = "Zq8#vT!p2LmX0"
    for before in ("passphrase:     ", "passphrase:\t\t  \t ", "password:\n  ", "password  \n  =\n ", "secret: password: ", "auth: token: ", "Authorization: token ", "Authorization: Bearer  ", "secret: password is ", "password => ", "token is ", "dbPassword='", "a=1&token=abc&secret=", "passphrase:" + " " * 100_000):
        text = f"{before}{strong} and more"
        secret = [text[s:e] for s, e, _, yes in secrets.priced_values(text, words) if yes]
        assert secret == [strong], before[:40]
    for text in ("password:\n\n  " + strong, "the word " + strong, "password " + strong):
        assert not any(yes for *_, yes in secrets.priced_values(text, words)), text
    for value in ("passphrase:qzxkvjwpqmzhtyrb", "passphrase: qzxkvjwpqmzhtyrb"):
        assert secrets.priced_values(value, words)[0][3]


def test_links_are_no_secrets_but_what_they_carry():
    words = secrets.load_words(PATH)
    for link in ("http://example.com/path/to/page", "https://www.some-long-host-name.example.org/news/2019/12/31/the-quick-brown-fox.html?page=2", "ftp://host"):
        assert secrets.redact_text(f"token: {link} is here", words) == f"token: {link} is here"
    for link in ("https://user:Zq8#vT!p2LmX0@example.com/", "https://example.com/x?key=q8Zv7TfLp2mX0kWs"):
        assert "[SECRET]" in secrets.redact_text(f"token: {link}", words)


def test_long_values_and_many_contexts_take_linear_time():
    rng = random.Random(1)
    began = time.time()
    secrets.guess_bits("".join(rng.choices("abcdefgh0123", k=20_000)))
    secrets.priced_values("password=" * 100_000)
    secrets.priced_values("token=abc&" * 20_000)
    secrets.priced_values(("password" + " " * 5_000) * 100 + "\n" * 100_000)
    assert time.time() - began < 60


def test_prose_stays_and_secrets_go():
    words = secrets.load_words(PATH)
    for t in ("the secret is understanding", "auth: authentication", "the token is immediately returned", "the password is Verständnisfragen.", "token: changeme", "secret: 2019-12-31", "password: qwertyuiop"):
        assert secrets.redact_text(t, words) == t
    for t, secret in (("clientSecret=a8#Kq!z9Lm", "a8#Kq!z9Lm"), ("PGPASSWORD='x9$vB2@qLp'", "x9$vB2@qLp"), ("Authorization: Bearer 7h&Gt_4kZq1!", "7h&Gt_4kZq1!"), ("auth: Basic dXNlcjpwYXNz9Q", "dXNlcjpwYXNz9Q"), ("the password is T7!kq9Zx#d", "T7!kq9Zx#d")):
        assert secret not in secrets.redact_text(t, words), t


def brute_base(text):
    spans = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "", re.I | re.A):
        if len(m[2]) >= 12:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))


def test_query_against_brute_force(spark):
    rng = random.Random(4)
    bits = ["password", "SECRET", "api_key", "apikey", "Token", " = ", ": ", "=", '"', "'", "AKIA", "ABCDEF0123456789", "0123456789abcdef", "hunter2", "é", "漢", "\n", " ", "a.b/c+d=e_f-g", "ſ", "K", "is ", "Zq8#vT!p2"]
    texts = [None, "", *("".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(400)), prose(1, 20_000) + " token=" + "Ab9" * 5000, "password=" * 3000, "same", "same"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).withColumns({"spans": F.lit("x"), "n_assign": F.lit("y"), "__s": F.lit(0)})
    got = {r["doc_id"]: r for r in secrets.scan(docs, PATH).collect()}
    assert len(got) == len(texts)
    words = secrets.load_words(PATH)
    for i, t in enumerate(texts):
        want = brute_base(t)
        kinds = [x.split(":")[0] for x in want.split(",") if x]
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(map(kinds.count, ("assign", "access", "hex"))), t
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(want.split(",")) <= set(got[i]["spans"].split(",")) or not want
        for x in filter(None, got[i]["values"].split(",")):
            s, e, price = x.split(":")
            if int(e) - int(s) < 80:
                assert float(price) == pytest.approx(brute_bits(t[int(s):int(e)], words), abs=0.01)
    assert secrets.scan(docs.limit(0)).count() == 0 and secrets.redact(docs, PATH).columns == docs.columns
