"""Phrases, personal data and importance resampling against brute force and on odd tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from veldspar.llm import importance, personal_data, phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- phrases -----------------------------------------------------------------------


def brute_phrases(docs, least, most_words, percent, most):
    """(lang, rank, phrase, a, l, r, n, score) by counting all runs of words."""
    f, n = collections.Counter(), collections.Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most_words + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in candidates.items():
        longer = [b for (other, v), b in candidates.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if any(100 * b >= percent * a for b in longer):
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, left, right, n[lang], score))
    ranked = []
    for lang in n:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:most]
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(own)]
    return sorted(ranked)


def mined(docs, most=2000, **options):
    return sorted(tuple(r) for r in phrases.top(*phrases.mine(docs, **options), most=most).collect())


def random_docs(seed, n=60):
    r = random.Random(seed)
    words = ["a", "b", "A", "ß", "new", "York", "c", "d", " x"]
    text = lambda: "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  "]) for _ in range(r.randrange(40)))
    rows = [(text(), r.choice(["en", "de", None, "und"])) for _ in range(n)]
    return rows + [(None, "en"), ("", None), (None, None), ("new york " * 300, "en"), rows[0], rows[0]]


@pytest.mark.parametrize(("seed", "most_words", "block"), [(1, 3, 1_000_000), (2, 4, 30), (3, 2, 7)])
def test_phrases_equal_brute_force(spark, seed, most_words, block):
    rows = random_docs(seed)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    want = brute_phrases(rows, 5, most_words, 50, 2000)
    assert mined(docs, least=5, most_words=most_words, block_places=block) == want
    assert len(want) > 20


def test_best_phrases_and_ties(spark):
    rows = random_docs(5)
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert mined(docs, most=4, least=3) == brute_phrases(rows, 3, 3, 50, 4)


def test_scores_pass_64_bits(spark):
    from pyspark.sql import functions as F

    big = [(10**13, 10**13 + 7, 3 * 10**13), (10, 10, 10), (10, 21, 31)]
    got = [r.s for r in spark.createDataFrame(big, "a bigint, l bigint, r bigint").select(phrases.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()]
    assert got == [1_000_000 * a * a // (x * y) for a, x, y in big]


def test_phrases_of_odd_tables(spark, odd_docs, no_docs):
    rows = [(r.text, r.lang) for r in odd_docs.collect()]
    assert mined(odd_docs, least=2) == brute_phrases(rows, 2, 3, 50, 2000)
    assert mined(no_docs) == []
    rare = spark.createDataFrame([("one two three", "en")], "text string, lang string")
    assert mined(rare) == []
    with pytest.raises(ValueError):
        phrases.mine(no_docs, most_words=1)


# --- personal data -----------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def check_digit_holds(digits):
    doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def brute_base(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and check_digit_holds(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


@pytest.mark.parametrize("parts", ["a@.0123+- é()", ["4111", "1111", "0", "12", " ", "-", "+", ".", "@", "9", "x.y", "255."]])
def test_base_spans_equal_the_patterns(parts):
    r = random.Random(7)
    for _ in range(15_000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(28)))
        assert [s for s in personal_data.find(text) if s[0] in personal_data.BASE] == brute_base(text), text


def test_further_kinds():
    cases = {
        "mail jörg@müller.de now": [("mailbox", 5, 19)],
        "write to anna.b (at) example (dot) com ok": [("mailbox", 9, 38)],
        "john at example dot com": [("mailbox", 0, 23)],
        "look at the example. com is at it": [],
        "https://bob:pw@host.org/x": [("email", 12, 23), ("login", 8, 14)],
        "see 2001:db8::8a2e:370:7334.": [("ip6", 4, 27)],
        "at 12:30:45 and ::1, std::string a::b": [],
        "DE89 3704 0044 0532 0130 00": [("iban", 0, 27)],
        "DE89 3704 0044 0532 0130 01": [],
        "IBAN GB82WEST12345698765432 x": [("iban", 5, 27)],
        "account number: 12345678": [("account", 16, 24)],
        "SSN 078-05-1120": [("account", 4, 15)],
        "accounts 123456, passport no. 123": [],
    }
    for text, want in cases.items():
        assert personal_data.find(text) == want, text


def test_long_and_odd_texts(spark, odd_docs, no_docs):
    found = {(r.doc_id, len(r.spans)) for r in personal_data.scan(odd_docs).collect()}
    assert found == {(r.doc_id, 0) for r in odd_docs.collect()}
    assert personal_data.scan(no_docs).count() == 0 and personal_data.redact(no_docs).count() == 0
    for text in ("a" * 300_000 + "@", "1 " * 200_000, "@" * 100_000, "::" * 100_000, "+1" * 100_000, "1." * 200_000, "://" * 50_000, "account" * 30_000):
        personal_data.find(text)
    mails = "x@y.zz " * 30_000
    assert len(personal_data.find(mails)) == 30_000


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "to a@b.cc or +1 (017) 555-7713!", "k"), (2, None, None), (3, "clean", "")], "doc_id bigint, text string, spans string")
    got = {r.doc_id: (r.text, r.spans) for r in personal_data.redact(docs).collect()}
    assert got == {1: ("to <email> or <phone>!", "k"), 2: (None, None), 3: ("clean", "")}


# --- importance --------------------------------------------------------------------


def grams(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return w, [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_resample(docs, target, percent, least, buckets):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = collections.Counter(bucket(g) for _, x in docs for g in grams(x)[1])
    t = collections.Counter(bucket(g) for x in target for g in grams(x)[1])
    n, m = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * n / ((s[b] + 1) * m)))
    out = []
    for i, (id_, x) in enumerate(docs):
        words, own = grams(x)
        weight = sum(gain(bucket(g)) for g in own)
        h = int(hashlib.sha256(f"42:{'null' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
        out.append([id_, len(words), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, i])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = rank + 1
    return sorted((tuple(r[:6]) for r in out), key=repr)


def test_resampling_equals_brute_force(spark):
    r = random.Random(2)
    words = ["a", "B", "é", "x1", "...", "42", "zz", "the"]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randrange(60)))) for i in range(300)]
    docs += [(None, docs[3][1]), (7, docs[7][1]), (7, docs[7][1]), (400, None), (401, "")]
    target = [" ".join(r.choice(words[:5]) for _ in range(30)) for _ in range(9)] + [None, ""]
    got = importance.resample(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame([(x,) for x in target], "text string"), percent=40, least_words=9, buckets=97)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == brute_resample(docs, target, 40, 9, 97)


def test_buckets_of_chunks_and_long_texts(monkeypatch):
    r = random.Random(3)
    texts = [" ".join(r.choice(["a", "bb", "ccc", "é" * r.randrange(1, 9)]) for _ in range(r.randrange(30))) for _ in range(40)]
    for size in (4, 5, 11, 400_000):
        monkeypatch.setattr(importance, "CHUNK_WORDS", size)
        words = [importance.WORD.findall(t.encode()) for t in texts]
        got = [b for some in importance._hashed(words, 1009) for b in some]
        for text, own in zip(texts, got, strict=True):
            import numpy as np

            assert sorted(np.frombuffer(own, "<u2").tolist()) == sorted(zlib.crc32(g.encode()) % 1009 for g in grams(text)[1])


def test_suffixes_are_in_order():
    chunk = importance.Chunk()
    for own in ([b"a", b"b", b"a", b"b", b"c"], [], [b"b", b"a"]):
        chunk.add(own)
    places, words, lcp = chunk.suffixes()
    rows = list(zip(*words.tolist(), strict=True))
    assert rows == sorted(rows) and sorted(places.tolist()) == [0, 1, 2, 3, 4, 7, 8]
    for i in range(1, len(rows)):
        same = next((k for k in range(3) if rows[i][k] != rows[i - 1][k]), 3)
        assert lcp[i] == same


def test_resampling_odd_tables(spark, odd_docs, no_docs):
    target = spark.createDataFrame([("the quick brown fox",)], "text string")
    got = importance.resample(odd_docs, target).collect()
    assert len(got) == odd_docs.count() and {r.n_features for r in got if r.doc_id == 4} == {0}
    assert importance.resample(no_docs, target).count() == 0
    assert importance.resample(odd_docs, target.limit(0), percent=100, least_words=1).where("rank is not null").count() == sum(len(grams(r.text)[0]) > 0 for r in odd_docs.collect())
