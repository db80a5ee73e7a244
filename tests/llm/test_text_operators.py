"""The text operators against brute force and libraries, and on odd tables."""

import collections
import hashlib
import math
import random
import re
import time
import types
import weakref
import zlib

import numpy as np
import pytest

from veldspar.llm import chat, decontaminate, html_main, mixing, quality_rank, quality_rules, secret_scan, token_counts, token_files
from veldspar.llm.entry import tokenizer_path
from veldspar.llm.shared import fresh_dir

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_hits(words, items, window):
    hit, ids = set(), set()
    for item, own in items:
        n = min(len(own), window)
        if not n:
            continue
        grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in grams:
                hit.update(range(i, i + n))
                ids.add(item)
    return hit, ids


@pytest.mark.parametrize("seed", range(6))
def test_automaton_equals_brute_force(seed):
    r = random.Random(seed)
    letters = "abc" if seed % 2 else "ab"
    items = [(str(k), [r.choice(letters) for _ in range(r.choice([0, 1, 2, 3, 6, 9]))]) for k in range(6)]
    automaton = decontaminate.SuffixAutomaton(items, 4)
    for _ in range(60):
        words = [r.choice(letters + "z") for _ in range(r.randrange(25))]
        spans, ids = automaton.scan(words)
        hit, want = brute_hits(words, items, 4)
        assert {k for a, b in spans for k in range(a, b)} == hit and ids == want


def test_a_large_benchmark_takes_no_copy_of_the_texts(spark):
    """Many shards are one pass: the plan has one Python scan, and no table is written for them."""
    bench = spark.createDataFrame([(k, " ".join(f"w{k}x{i}" for i in range(400))) for k in range(50)], "item_id bigint, text string")
    docs = spark.createDataFrame([(k, f"begin w{k}x5 w{k}x6 w{k}x7 w{k}x8 end") for k in range(50)] + [(99, None)], "doc_id bigint, text string")
    found = decontaminate.find_hits(docs, bench, window=3, max_shard_words=1000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "parquet" not in plan.lower()
    got = {r.doc_id: (r._hits["n_words"], [(s.start, s.end) for s in r._hits["spans"]], r._hits["items"]) for r in found.collect()}
    assert got == {k: (6, [(1, 5)], [str(k)]) for k in range(50)} | {99: (0, [], [])}


def test_decontamination_shards_agree(spark):
    r = random.Random(3)
    bench = spark.createDataFrame([(k, " ".join(r.choice("abcdef") for _ in range(r.randrange(30)))) for k in range(8)] + [(None, "a b c"), (9, None)], "item_id bigint, text string")
    docs = spark.createDataFrame([(k, " ".join(r.choice("abcdefg") for _ in range(80))) for k in range(10)], "doc_id bigint, text string")
    whole = decontaminate.hit_report(docs, bench, window=4).orderBy("doc_id").collect()
    parts = decontaminate.hit_report(docs, bench, window=4, max_shard_words=20).orderBy("doc_id").collect()
    assert [(x.n_hit, x.items) for x in whole] == [(x.n_hit, x.items) for x in parts]
    assert any(x.n_hit for x in whole)


def test_clean_cuts_spans_and_drops_leaks(spark, odd_docs):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "Keep this, alpha beta GAMMA delta epsilon! and also keep that and more and more", 0), (2, "alpha beta gamma delta epsilon", 0), (3, "untouched  text\n here", 0)], "doc_id bigint, text string, n_chars bigint")
    out = {x.doc_id: x for x in decontaminate.clean(docs, bench, window=5, count_col="n_chars").collect()}
    assert out[1].text == "Keep this, ! and also keep that and more and more" and out[1].n_chars == len(out[1].text)
    assert 2 not in out and out[3].text == "untouched  text\n here"
    same = decontaminate.clean(odd_docs, bench)
    assert same.columns == odd_docs.columns and same.count() == odd_docs.count()
    none = decontaminate.clean(odd_docs, bench.limit(0))
    assert none.count() == odd_docs.count()


def test_token_files_round_trip(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    root = fresh_dir(spark, "t")
    manifest = token_files.write(odd_docs, root, path, partitions=3)
    got = token_files.read(spark, root).orderBy("start").collect()
    rows = odd_docs.collect()
    assert manifest["n_docs"] == len(rows) == len(got)
    ids = [x.doc_id for x in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    want = collections.Counter((r.doc_id, tuple([*tok.encode(r.text or "", add_special_tokens=False).ids, 2])) for r in rows)
    assert collections.Counter((x.doc_id, tuple(x.ids)) for x in got) == want
    start = 0
    for x in got:
        assert x.start == start and x.n_tokens == len(x.ids) and x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes())
        start += x.n_tokens
    root = fresh_dir(spark, "t")
    assert token_files.write(no_docs, root, path)["n_docs"] == 0 and token_files.digests(spark, root).count() == 0


def odd_texts():
    r = random.Random(1)
    alphabet = "abcdeéßñ ▁\n\t日本ゼ😀0123.,;-—   　the'"
    return ["", " ", "  a  b ", "it's we'll x y", "a <|endoftext|> b", "<s> hi </s>", "\x00\x1c a", "x᠎ ᠎."] + [" " * n for n in range(40)] + ["".join(r.choice(alphabet) for _ in range(r.randrange(90))) for _ in range(400)]


def test_encoder_equals_library():
    e = token_files.Encoder(tokenizer_path("byte_bpe_50k.json"))
    texts = odd_texts()
    for text, got in zip(texts, e.encode(texts), strict=True):
        assert got.tolist() == e.library.encode(text, add_special_tokens=False).ids, text


def test_encoder_keeps_what_comes_again():
    """A full cache lets go what came once; before, it forgot all, so that it had to be larger."""
    e = token_files.Encoder(tokenizer_path("byte_bpe_50k.json"))
    e.chunks.most = 300
    asked, library = collections.Counter(), e._library
    e._library = lambda texts: (asked.update(texts), library(texts))[1]
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abcdefgß日é") for _ in range(n))
    texts = [f"{word(4)}?! \n often1 {word(5)}, again2 {word(9)}" for _ in range(2000)]
    for text, got in zip(texts, e.encode(texts), strict=True):
        assert got.tolist() == e.library.encode(text, add_special_tokens=False).ids, text
    assert len(e.chunks) == e.known <= 300 + 64 * 8 and e.chunks.chars == sum(map(len, e.chunks))
    assert asked[" \n often1"] == asked[" again2"] == 1


def test_encoder_memory():
    """Two workers of an executor have 300 MB each at most beside its JVM: the chunks' share is bounded."""
    e = token_files.Encoder(tokenizer_path("byte_bpe_50k.json"))
    for lo in range(0, 360_000, 3600):
        for _ in e.encode([" ".join(f"{k:x}" for k in range(lo, lo + 3600))]):
            pass
    assert len(e.chunks) <= 310_000


def test_scan_holds_the_words_of_one_text(monkeypatch):
    """Before, the words of all texts of a batch were held at once."""
    held, most = weakref.WeakSet(), 0

    class Words(list):
        pass

    def words_of(text, split=decontaminate.words_of):
        nonlocal most
        held.add(own := Words(split(text)))
        most = max(most, len(held))
        return own

    Words.__hash__ = object.__hash__
    monkeypatch.setattr(decontaminate, "words_of", words_of)
    for parts in (0, 1, 2):
        automata = [types.SimpleNamespace(value=decontaminate.SuffixAutomaton([(f"i{k}", ["a", "b", f"c{k}"])], 2)) for k in range(parts)]
        rows = decontaminate._rows([f"x a b c1 {k} a" for k in range(50)] + [None], automata)
        assert rows[-1] == (0, [], []) and [x[0] for x in rows[:-1]] == [6] * 50
        assert all(x[1:] == (([{"start": 1, "end": 4 if parts > 1 else 3, "first": 2, "last": 8 if parts > 1 else 5}], [f"i{k}" for k in range(parts)]) if parts else ([], [])) for x in rows[:-1])
        automata.clear()
    assert most <= 2


def test_piece_counts_equal_library(spark, odd_docs, no_docs):
    m = token_counts.PieceMerger(tokenizer_path("piece_bpe_32k.model"))
    texts = odd_texts()
    assert m.count(texts) == [len(x) for x in m.library.encode(texts)]
    out = token_counts.count_tokens(odd_docs, tokenizer_path("piece_bpe_32k.model")).collect()
    want = collections.Counter((r.doc_id, len((r.text or "").encode()), len(m.library.encode(r.text or ""))) for r in odd_docs.collect())
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in out) == want
    assert token_counts.count_tokens(no_docs, tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_html_cases(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><h2>Site</h2></header><nav><a href=x>Home</a> <a href=y>News</a></nav>
    <div class="cookie-notice">We use cookies</div><div id=main><article><h1>The &amp; title</h1><p>First   paragraph of the article &mdash; with enough words to count as text.
    <p>Second one, <b>bold</b> and a <a href=z>link</a><br>after the break.<ul><li>one item<li>two items</ul></article>
    <section class="comments"><p>A reader says something quite long about the article, to be left out.</p></section></div>
    <aside>Side</aside><form>Search</form><footer>&copy; 2026</footer></body></html>"""
    assert html_main.main_blocks(page) == ["The & title", "First paragraph of the article — with enough words to count as text.", "Second one, bold and a link after the break.", "one item", "two items"]
    assert html_main.main_blocks(None) == [] and html_main.main_blocks("") == [] and html_main.main_blocks("<p>") == []
    assert html_main.main_blocks("just text & more") == ["just text & more"]
    assert html_main.main_blocks("<div>" * 5000 + "deep words here") == ["deep words here"]
    df = spark.createDataFrame([(1, "u", page, 1), (1, "u", page, 1), (None, None, None, None)], "page_id bigint, url string, html string, text int")
    assert sorted((r.n_chars for r in html_main.extract(df).collect())) == sorted([0, *[len("\n\n".join(html_main.main_blocks(page)))] * 2])
    assert html_main.extract(df.limit(0)).count() == 0


def test_html_keeps_links_and_content_of_any_class():
    text = "Some words of the text that are long enough to count as the main part of this page. "
    parts = ["<h2><a href=#s>Section</a></h2>", f"<p>{text}</p>", "<p><a href=r>Read the report</a></p>", "<ul><li><a href=1>reference</a></li></ul>"]
    want = ["Section", text.strip(), "Read the report", "reference"]
    nav = "<nav><a href=x>Home</a></nav><div class=sidebar><a href=y>More</a></div>"
    for page in ("<article>{}</article>", "<main class=has-sidebar>{}</main>", "<article class='post share-enabled'>{}</article>", "<div id=related><article>{}</article></div>", "<div class='page with-sidebar'>{}</div>"):
        assert html_main.main_blocks(f"<body>{nav}{page.format(''.join(parts))}</body>") == want, page
    comments = f"<div class=comments><article class=comment>{text * 3}</article></div>"
    assert html_main.main_blocks(f"<body>{nav}<article><p>{text}</p>{comments}</article></body>") == [text.strip()]
    assert html_main.main_blocks(f"<body>{nav}<article><p>{text}</p></article><div class=comments><p>{text * 3}</p></div></body>") == [text.strip()]


def brute_secrets(text):
    found = []
    for kind, p, ok in (
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ):
        found += [(kind, *m.span()) for m in p.finditer(text) if ok(m)]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secret_values_that_no_base_span_covers():
    text = "password=hunter22!Xk#9$qQ and more"
    assert secret_scan.find(text) == [("assign", 0, 17), ("guess", 9, 25)]
    assert secret_scan.find("token = Zk3vQ9xLw2Rt") == [("assign", 0, 20)]
    assert secret_scan.find("pwd: xqzjvkwpqhzt") == [("guess", 5, 17)]
    assert secret_scan.find("The Password IS xqzjvkw9qhzt") == [("guess", 16, 28)]
    assert secret_scan.find("pwd: letmeinqwertyuiop") == []


def test_secret_base_equals_brute_force(spark, odd_docs):
    r = random.Random(2)
    parts = ["password", "TOKEN", "api_key", "apikey=", ": ", "=", '"', "AKIA", "ABCDEFGH0123", "deadbeef" * 3, " ", "hunter2", "paſſword=abcdefgh", "é", "secret"]
    for _ in range(1500):
        text = "".join(r.choice(parts) for _ in range(r.randrange(14)))
        spans = secret_scan.find(text)
        assert [s for s in spans if s[0] != "guess"] == brute_secrets(text)
    assert [s[0] for s in secret_scan.find("the pwd: x8Kq2!vLp9zW is new")] == ["guess"]
    assert secret_scan.find("pwd: password1") == [] and secret_scan.find(None) == []
    out = secret_scan.scan(odd_docs)
    assert out.count() == odd_docs.count()


def test_guess_cost_is_the_least():
    """The segmentation costs no more than any cut into its own kinds of parts."""
    assert secret_scan.guess_bits("password") < 8 and secret_scan.guess_bits("aaaaaaaaaa") < 10 and secret_scan.guess_bits("19990101") < 18
    for v in ("password19990101aaaa", "qwertyzx!9", "xK9#"):
        parts = secret_scan.segments(v)
        assert [p[1] for p in parts] == [0, *[p[2] for p in parts[:-1]]] and parts[-1][2] == len(v)
        for k in range(1, len(v)):
            assert secret_scan.guess_bits(v) <= secret_scan.guess_bits(v[:k]) + secret_scan.guess_bits(v[k:]) + 1e-9


def test_values_beyond_ascii_are_scanned_whole():
    assert secret_scan.find("pwd: Zk3ñvQ9xLw2Rt8") == [("guess", 5, 19)]
    text = "password: contraseñaLarga9XkQ#7z"
    assert secret_scan.find(text) == [("assign", 0, 18), ("guess", 10, len(text))]
    assert secret_scan.find("token: пожалуйстаспасибо") == []


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality_rank.train(docs, labels)
    assert model == quality_rank.train(docs.repartition(7), labels.repartition(3))
    scored = quality_rank.score(docs, model).join(labels, "doc_id").where(quality_rank.fold(labels.doc_id) == 0).collect()
    assert len(scored) > 50 and sum((r.score >= 0.3) == (r.quality == 1) for r in scored) / len(scored) > 0.95


def test_ranking_equals_plain_descent():
    """Weights by plain gradient descent on the same pairs, and the cut by trying every place."""
    rng = np.random.default_rng(1)
    n, d = 160, len(quality_rank.NAMES)
    y = (rng.random(n) < 0.6).astype(int)
    x = rng.normal(size=(n, d)) + 0.4 * y[:, None] * rng.normal(size=d)
    model = quality_rank.fit(x, y, threshold=0.3, pairs_each=5, penalty=0.02, seed=3)
    z = ((x - x.mean(0)) / x.std(0)).clip(-8, 8)
    good, bad, r = np.flatnonzero(y == 1), np.flatnonzero(y == 0), np.random.default_rng(3)
    over = [*zip(r.choice(good, len(bad) * 5), np.repeat(bad, 5), strict=True), *zip(np.repeat(good, 2), r.choice(bad, len(good) * 2), strict=True)]
    diff = np.array([z[a] - z[b] for a, b in over])
    w = np.zeros(d)
    for _ in range(20_000):
        lost = 1 / (1 + np.exp(diff @ w))
        w += 0.5 * ((diff * lost[:, None]).mean(0) - 0.02 * w)
    assert np.allclose(model.weights, w, atol=1e-6)
    scores = np.sort(z @ w)
    middles = [scores[0] - 0.5, *((scores[1:] + scores[:-1]) / 2), scores[-1] + 0.5]
    gain = [((z @ w < c) & (y == 0)).sum() / len(bad) - 2 * ((z @ w < c) & (y == 1)).sum() / len(good) for c in middles]
    cut = np.log(0.3 / 0.7) - model.offset
    own = ((z @ w < cut) & (y == 0)).sum() / len(bad) - 2 * ((z @ w < cut) & (y == 1)).sum() / len(good)
    assert own == pytest.approx(max(gain)) and np.allclose(model.score(x), 1 / (1 + np.exp(-(z @ w - cut + np.log(0.3 / 0.7)))), atol=1e-5)


def test_quality_long_texts_and_named_columns(spark):
    docs = spark.createDataFrame([(1, "word and more of it. " * 40_000, 5.0), (2, "word and more of it. " * 40_000, 6.0), (3, None, 7.0)], "doc_id bigint, text string, score double")
    model = quality_rank.Ranker((0.0,) * len(quality_rank.NAMES), (1.0,) * len(quality_rank.NAMES), (0.1,) * len(quality_rank.NAMES), 0.0)
    got = {r.doc_id: r.score for r in quality_rank.score(docs, model).collect()}
    assert got[1] == got[2] != got[3] and all(0 <= s <= 1 for s in got.values())


def test_quality_odd_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (None, 0), (6, 0), (7, None)], "doc_id bigint, quality int")
    kept = quality_rank.keep_good(odd_docs, labels)
    assert kept.columns == odd_docs.columns
    assert quality_rank.keep_good(odd_docs, labels.limit(0)).count() == odd_docs.count()
    assert quality_rank.keep_good(no_docs, labels).count() == 0


def test_quality_rules_equal_brute_force(spark, odd_docs, no_docs):
    r = random.Random(5)
    texts = [" ".join(r.choice(["a", "b", "the", "X#", "|", "\n", "c"]) for _ in range(r.randrange(60))) for _ in range(300)] + [None, "", "  \n "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for row in quality_rules.judge(df).collect():
        text = row.text or ""
        w = SPACE_WORDS.findall(text)
        count = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {k for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in text.split("\n") if SPACE_WORDS.search(x)]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert row.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (row.base_failed and row.kept)
    out = quality_rules.judge(odd_docs)
    assert out.count() == odd_docs.count() and {"n_words", "n_words_"} <= set(out.columns)
    assert quality_rules.judge(no_docs).count() == 0


@pytest.mark.parametrize("budget", [20, 60, 500])
def test_chat_windows_read_back(spark, budget):
    r = random.Random(4)
    odd = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|im_start|> a\\", "", None, "plain words " * 9]
    rows = [(c, t, "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2], r.choice(odd)) for c in range(5) for t in range(r.randrange(1, 30))]
    rows += [(None, 0, None, "x"), (None, None, "assistant", "y"), (7, 1, "user", "same"), (7, 1, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    made = chat.windows(df, budget=budget, range_size=4)
    out = {x.conv_id: x for x in chat.read_back(made).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append(((t is not None, t or 0), role or "", text or ""))
    assert out.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert (out[c].n_turns, out[c].turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for w in made.collect():
        assert w.text.count("<|im_start|>") == len(w.parts) == w.text.count("<|im_end|>")
        assert [p.nth for p in w.parts] == sorted(p.nth for p in w.parts)
        if any(not p.new for p in w.parts if p.nth):
            assert w["size"] <= budget or sum(p.new for p in w.parts) >= 1
    assert chat.windows(df.limit(0)).count() == 0


def fill(sizes, weights, share, most):
    """Targets by repeated sharing, as the rule is told."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        t = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if t[s] >= most * sizes[s]}
        if not over:
            return target | t
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing(spark, odd_docs, no_docs):
    r = random.Random(6)
    rows = [(k, "w " * r.randrange(30), r.choice(["a", "b", "c", "d", None, "hot", "hot", "hot"])) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mix(df).collect()
    sizes = collections.Counter()
    for _, text, s in rows:
        sizes[s] += len(text.split())
    want = fill(dict(sizes), (3, 1, 2), 1.5, 2.0)
    taken = collections.Counter()
    for x in out:
        assert x.source_size == sizes[x.source] and abs(x.target - want[x.source]) < 1e-6 and 0 <= x.taken <= 2 * x.size
        taken[x.source] += x.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-9 for s in sizes)
    again = {x.doc_id: x.taken for x in mixing.mix(df.repartition(5)).collect()}
    assert again == {x.doc_id: x.taken for x in out}
    picked = mixing.sample(df).collect()
    assert sum(len(x.text.split()) for x in picked) == sum(taken.values())
    assert mixing.mix(odd_docs).count() == odd_docs.count() and mixing.sample(odd_docs, count_col="n_chars").columns == odd_docs.columns
    assert mixing.mix(no_docs).count() == 0 and mixing.sample(no_docs).count() == 0


def cheapest(value, words):
    """Least cost over all segmentations, each part by the cheapest of its kinds."""
    low = value.lower()
    plain = low.translate(secret_scan._LEET)
    best = [0.0]
    for j in range(1, len(value) + 1):
        costs = []
        for i in range(j):
            part, n = value[i:j], j - i
            ways = [sum(map(secret_scan._char_bits, part))]
            steps = [secret_scan._step(a, b) for a, b in zip(low[i:j], low[i + 1 : j], strict=False)]
            if n >= 3 and len(set(part)) == 1:
                ways.append(secret_scan._char_bits(part[0]) + math.log2(n))
            if n >= 3 and None not in steps:
                ways.append(math.log2(47) + math.log2(n) + 2 * sum(a != b for a, b in zip(steps, steps[1:], strict=False)))
            if rank := words.get(plain[i:j]) or words.get(low[i:j]):
                ways.append(secret_scan._word_bits(part, low[i:j], plain[i:j], rank))
            if n in (4, 8, 10) and secret_scan._DATE.fullmatch(part):
                ways.append(math.log2(130) if n == 4 else math.log2(130 * 366) + n - 8)
            costs.append(best[i] + 1 + min(ways))
        best.append(min(costs))
    return best[-1]


def test_guess_cost_equals_all_segmentations():
    assert secret_scan.guess_bits("passwordrty") <= 12.15
    r = random.Random(11)
    parts = ["a", "aaa", "qwe", "rty", "pass", "word", "1999", "0101", "12", "X", "#", "p4ss", "bb", "cde", "Q", "9", "4b4b"]
    for k in range(3000):
        v = "".join(r.choice(parts) for _ in range(r.randrange(1, 6)))[:10] if k % 2 else "".join(r.choice("abc12#Qw") for _ in range(r.randrange(1, 11)))
        want = cheapest(v, secret_scan._RANKS)
        assert abs(secret_scan.guess_bits(v) - want) < 1e-9, v
        for most in (10.0, 36.0):
            assert (secret_scan.segments(v, most=most) is None) == (want >= most)


def test_secret_long_values_ties_and_vocabulary(spark, no_docs):
    words = secret_scan.ranks(tokenizer_path("byte_bpe_50k.json"))
    assert len(words) > 10_000 and words["password"] == 1 and secret_scan.guess_bits("correcthorse", words) < secret_scan.guess_bits("correcthorse")
    for v in ("ab" * 50_000, "password" * 10_000, "qwertyuiop" * 10_000):
        assert secret_scan.segments(v, words, 36.0) is None
    assert secret_scan.segments("x" * 20_000, words, 36.0) is not None
    # An assignment and a hexadecimal run that start together, and a run inside an assignment.
    assert secret_scan.find("token=" + "deadbeef" * 4)[0][0] == "assign"
    assert [s[0] for s in secret_scan.find("a" * 24 + " AKIA" + "A1" * 8)] == ["hex", "access"]
    assert secret_scan.scan(no_docs).count() == 0


def tree_measures(n, skip):
    """(C, T, LC, LT) of a node by their definitions."""
    texts = [re.sub(r"\s+", " ", c).strip() for c in n.children if isinstance(c, str)]
    c, t, lc, lt = sum(map(len, texts)), 0, 0, 0
    for x in n.children:
        if not isinstance(x, str) and x.tag not in skip:
            a, b, d, e = tree_measures(x, skip)
            c, t, lc, lt = c + a, t + b + 1, lc + d, lt + e
    return (c, t, c, lt + 1) if n.tag == "a" else (c, t, lc, lt)


def test_html_density_equals_its_definition():
    r = random.Random(8)

    def page(depth):
        out = []
        for _ in range(r.randrange(1, 5)):
            tag = r.choice(["div", "p", "a", "span", "section", "li", "article"])
            out.append(f"<{tag}>{page(depth - 1) if depth and tag != 'p' else 'words of text ' * r.randrange(6)}</{tag}>")
        return " loose ".join(out)

    for _ in range(60):
        root = html_main.parse(f"<body>{page(4)}</body>")
        body = root.children[0]
        nodes = html_main._ordered(body)
        html_main._score(nodes, body)
        whole = tree_measures(body, html_main.SKIP)
        density = {}
        for n in nodes:
            c, t, lc, lt = tree_measures(n, html_main.SKIP)
            base = math.log(c / max(1, c - lc) * lc + (whole[2] / whole[0] if whole[0] else 0) * c + math.e)
            density[id(n)] = c / max(t, 1) * math.log(max(1.0, c / max(lc, 1) * max(t, 1) / max(lt, 1))) / base if c else 0.0
            assert math.isclose(n.density, density[id(n)], rel_tol=1e-9)
        for n in nodes:
            own = sum(len(re.sub(r"\s+", " ", c).strip()) for c in n.children if isinstance(c, str))
            assert math.isclose(n.total, own + sum(density[id(c)] for c in n.children if not isinstance(c, str) and c.tag not in html_main.SKIP), rel_tol=1e-9)
        best, threshold, around = html_main._chosen(nodes, body)
        inside = lambda n: n.tag in ("article", "main") or n is not body and inside(n.parent)
        choice = [n for n in nodes if n.chars and inside(n)] or nodes
        assert best.total == max(n.total for n in choice) and (around is not None) == inside(best)
        up, path = best, [best.density]
        while up is not body:
            up = up.parent
            path.append(up.density)
        assert threshold == min(path)


def test_html_whole_articles_side_columns_and_broken_pages():
    text = "Some words of the text that are long enough to count as the main part of this page. "
    three = f"<p>{text}</p>" * 3
    want = [text.strip()] * 3
    for page in (f"<div class='content no-sidebar'>{three}</div>", f"<article class='post has-comments'>{three}</article>", f"<main id='ad-free'>{three}</main>"):
        assert html_main.main_blocks(page) == want
    column = "<div><p>Home</p><p>Products we sell today</p><p>Buy now...</p></div>"
    assert html_main.main_blocks(f"<body><div class=w>{column}<div><h1>Title</h1>{three}</div></div></body>") == ["Title", *want]
    assert html_main.main_blocks(f"<body><div>{column}<h1>Title</h1><div>{three}</div><div>{three}</div></div></body>") == ["Title", *want, *want]
    # Of equal sums the first is chosen.
    assert html_main.main_blocks(f"<body><article>{three}</article><article>{three.replace('Some', 'More')}</article></body>") == want
    began = time.time()
    assert html_main.main_blocks("</b>" * 100_000 + "text here") == ["text here"]
    for page in ("<b>" * 30_000 + "<li></li>" * 30_000, "<b>" * 30_000 + "<div>x</div>" * 30_000, "<a " * 30_000 + '"', "< " * 50_000, "<p>x" * 30_000, "<header>" * 30_000, "<body>" * 30_000):
        html_main.main_blocks(page)
    assert time.time() - began < 60
    long = "word " * 300_000
    assert html_main.main_blocks(f"<article><p>{long}</p></article>") == [long.strip()]


def test_long_words_equal_library():
    m = token_counts.PieceMerger(tokenizer_path("piece_bpe_32k.model"))
    r = random.Random(13)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "aethnors", "xX=-_#", "é日a1", "abcABC0123"):
        for n in (257, 700, 5000):
            word = "".join(r.choice(letters) for _ in range(n))
            assert m.count([word]) == [len(m.library.encode(word))], (letters, n)
    began = time.time()
    word = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    assert m.count([word]) == [len(m.library.encode(word))] and time.time() - began < 30


def test_benchmark_shards_are_bounded(spark):
    r = random.Random(2)
    word = lambda: f"w{r.randrange(500)}"
    rows = [(k, " ".join(word() for _ in range(r.choice([5, 60, 700])))) for k in range(60)] + [(1, "the same item again and again and once more so")] * 3000
    bench = spark.createDataFrame(rows, "item_id bigint, text string")
    shards = list(decontaminate._shards(bench, "item_id", "text", 5, 2000))
    assert len(shards) > 3 and max(sum(len(w) for _, w in s) for s in shards) < 3000
    windows = lambda items: {(str(i), tuple(w[k : k + 5])) for i, w in items for k in range(len(w) - 4)}
    assert set().union(*map(windows, shards)) == windows([(i, t.split()) for i, t in rows])


def test_chat_of_one_crowded_conversation(spark):
    """Rows without a conversation, of one turn and of none, give the same windows cut into fine ranges, none of which holds them all."""
    r = random.Random(6)
    rows = [(None, r.choice([None, 0, 0, 1]), r.choice(["user", "assistant", None]), f"text {r.randrange(400)}") for _ in range(600)]
    rows += [(c, t, ("user", "assistant")[t % 2], f"turn {t}") for c in range(3) for t in range(20)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    plain = {(x.conv_id, x.window): (x.size, x.text, x.loss) for x in chat.windows(df, budget=64, range_rows=10**9).collect()}
    for range_rows, most in ((5, None), (5, 0)):
        before, chat.MOST_BROADCAST = chat.MOST_BROADCAST, chat.MOST_BROADCAST if most is None else most
        try:
            fine = {(x.conv_id, x.window): (x.size, x.text, x.loss) for x in chat.windows(df, budget=64, range_rows=range_rows).collect()}
        finally:
            chat.MOST_BROADCAST = before
        assert fine == plain and len(plain) > 60


def test_chat_long_texts_and_clashing_columns(spark):
    long = "tick " * 60_000
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", long), (1, 2, "assistant", long + "end"), (1, 3, "user\nodd", "x"), (1, 4, "assistant", "y")]
    df = spark.createDataFrame([(*r, 5, "w", 7) for r in rows], "conv_id bigint, turn bigint, role string, text string, size int, window string, nth int")
    made = chat.windows(df, budget=64)
    out = chat.read_back(made).collect()
    whole = "".join(f"{role}\n{text}\n" for _, _, role, text in rows)
    assert [(x.n_turns, x.turns_sha256, x.loss_chars) for x in out] == [(5, hashlib.sha256(whole.encode()).hexdigest(), len(long) + 4)]
    assert all(w.text.startswith("<|im_start|>system\nbe brief<|im_end|>\n") for w in made.collect())


def test_pipeline_stages_take_odd_tables(spark, odd_docs, no_docs):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd_docs, d)
        assert out.columns == odd_docs.columns or name == "token files"
        assert 0 < out.count()
        assert stage(spark, no_docs, d).count() == 0
