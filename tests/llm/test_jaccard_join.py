"""The join against all pairs, and the pipeline on small tables."""

import random

import numpy as np
import pytest

from veldspar.llm import components, jaccard_join as jj


def brute(rows, k, percent):
    """Least id reachable by links, by comparing all sets."""
    low = {c: c + 32 for c in range(65, 91)}

    def tokens(text):
        w = (text or "").translate(low).encode().split()
        return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()

    sets = [tokens(t) for _, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b in range(a):
            x = len(sets[a] & sets[b])
            if x and 100 * x >= percent * (len(sets[a]) + len(sets[b]) - x):
                p, q = sorted((find(i), find(rows[b][0])))
                parent[q] = p
    return {i: find(i) for i, _ in rows}, [len(s) for s in sets]


def family(r, base, n, most):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(most + 1)):
            w[r.randrange(len(w))] = f"v{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k,percent,blocks", [(4, 85, 256), (5, 80, 8), (2, 50, 4), (1, 100, 8)])
def test_equals_all_pairs(spark, monkeypatch, k, percent, blocks):
    monkeypatch.setattr(jj, "BLOCK_SETS", blocks)
    r = random.Random(k)
    texts = [" ".join(r.choice("abcdefgh") for _ in range(r.randrange(14))) for _ in range(120)]
    texts += family(r, [f"w{i}" for i in range(120)], 40, 8) + family(r, [f"x{i}" for i in range(30)], 25, 3) + family(r, [f"y{i}" for i in range(400)], 12, 40)
    texts += ["A b C d e", "a B c D e", "", None, " \t"]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    out = jj.near_duplicates(df, words=k, percent=percent).collect()
    want, sizes = brute(rows, k, percent)
    assert {x.doc_id: x.component_id for x in out} == want
    assert {x.doc_id: x.n_shingles for x in out} == dict(zip([i for i, _ in rows], sizes, strict=True))


def test_signatures_miss_no_link():
    r = random.Random(9)
    for percent in (80, 85, 95):
        classes = jj.Classes(percent)
        for _ in range(400):
            n = r.choice([1, 2, 5, 6, 7, 12, 40, 150, 600])
            a = np.unique(np.array([r.getrandbits(64) for _ in range(n)], np.uint64))
            most = (100 - percent) * len(a) // 100
            b = np.unique(np.r_[a[r.randrange(most + 1) :], np.array([r.getrandbits(64) for _ in range(r.randrange(most + 1))], np.uint64)])
            x = len(np.intersect1d(a, b))
            if 100 * x >= percent * (len(a) + len(b) - x):
                sig, node = classes.signatures([a, b], np.array([1, 2]))
                assert np.intersect1d(sig[node == 1], sig[node == 2]).size


def test_odd_tables(spark, odd_docs, no_docs):
    out = {(r.doc_id, r.n_shingles): r.component_id for r in jj.near_duplicates(odd_docs).collect()}
    assert out[(2, 17)] == 1 and out[(3, 0)] == 3 and out[(4, 0)] == 4 and out[(9, 1)] == 9 and out[(None, 0)] is None
    kept = jj.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), (False, 0), *[(True, i) for i in (1, 3, 4, 5, 6, 7, 8, 9)]]
    assert jj.near_duplicates(no_docs).count() == 0 and jj.deduplicate(no_docs).count() == 0


def test_rows_without_an_id_or_of_one_id_are_documents_of_their_own(spark):
    word = lambda name: " ".join(f"{name}{i}" for i in range(40))
    near = lambda name: word(name) + " end"
    rows = [(None, word("a")), (None, word("b")), (None, word("c")), (None, word("c")), (None, near("c"))]
    rows += [(5, near("a")), (9, near("b")), (7, word("d")), (7, word("e")), (8, near("d")), (6, near("e"))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = sorted(((r.doc_id or 0, r.component_id or 0) for r in jj.near_duplicates(df).collect()))
    assert out == [(0, 0), (0, 0), (0, 0), (0, 5), (0, 9), (5, 5), (6, 6), (7, 6), (7, 7), (8, 7), (9, 9)]
    kept = {(r.doc_id, r.text) for r in jj.deduplicate(df).collect()}
    assert {x for x in kept if x[0]} == {(5, near("a")), (9, near("b")), (7, word("d")), (6, near("e"))}
    assert len(kept) == 5 and jj.deduplicate(df).count() == 5


def test_many_copies_without_an_id_are_one(spark):
    text = "one text of many rows without an id and enough words"
    df = spark.createDataFrame([(None, text)] * 1500 + [(None, f"other words {i} of row {i * 7}") for i in range(30)], "doc_id bigint, text string")
    assert sorted(r.text for r in jj.deduplicate(df).collect()) == sorted({r.text for r in df.collect()})


def test_components_of_chains_stars_and_loops(spark):
    r = random.Random(1)
    chain = list(range(100, 160))
    edges = list(zip(chain, chain[1:], strict=False)) + [(7, x) for x in range(1000, 1050)] + [(3, 3), (5, 4), (4, 5)]
    r.shuffle(edges)
    out = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert out == {**{c: 100 for c in chain}, 7: 7, **{x: 7 for x in range(1000, 1050)}, 4: 4, 5: 4}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, before = docs.columns, docs
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), before.schema)
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] <= counts[2]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, d).orderBy("start").collect()
    assert len(out) == counts[-1] and out[0].start == 0
    empty = before.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, d).count() == 0, name


def rough_pairs(spark, texts, words, percent):
    common = np.zeros(jj.CELLS, bool)
    return {frozenset(r) for r in jj._candidates(spark.createDataFrame([(t,) for t in texts], "text string"), words, percent, 0, common).collect()}


def test_phrases_alone_make_no_candidates(spark):
    # Texts of one size, each sharing one sentence with the next: no two are near, and no group should grow along them.
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=7))
    shared = [" ".join(word() for _ in range(18)) for _ in range(1501)]
    texts = [f"{shared[i]} {' '.join(word() for _ in range(84))} {shared[i + 1]}" for i in range(1500)]
    assert len(rough_pairs(spark, texts, 5, 80)) < 10


def test_candidates_hold_every_link_at_the_limit(spark):
    r = random.Random(6)
    texts = []
    for n in (3, 8, 20, 60, 130, 300) * 4:
        base = [f"w{r.randrange(10**9)}" for _ in range(n)]
        for _ in range(r.choice((2, 5, 20))):
            w = list(base)
            for _ in range(r.randrange(1 + n // 60)):
                w[r.randrange(n)] = f"x{r.randrange(10**9)}"
            texts.append(" ".join(w[r.randrange(1 + n // 60) :]))
    sets = {jj.set_node(s): set(s.tolist()) for s in (jj.token_set(t, 5) for t in texts)}
    label = {n: n for n in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in map(tuple, rough_pairs(spark, texts, 5, 80)):
        label[find(a)] = find(b)
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(linked) > 100
    assert all(find(a) == find(b) for a, b in linked)


def test_rows_looked_up_by_a_map_of_keys(spark):
    rows = spark.createDataFrame([(i * 7919 * 10**12 - 5 * 10**17, f"t{i}") for i in range(400)] + [(-1, "u"), (-1, "v")], "key bigint, word string")
    some, others = jj._looked_up(rows, rows.where("word < 't2'").select("key"), "key")
    some, others = ({r.word for r in x.collect()} for x in (some, others))
    assert not some & others and len(some | others) == 402
    assert {r.word for r in rows.where("word < 't2'").collect()} <= some and len(some) < 160


def test_deduplicate_by_the_map_and_by_the_join(spark, monkeypatch):
    r = random.Random(8)
    rows = []
    for i in range(60):
        base = [f"w{r.randrange(10**9)}" for _ in range(80)]
        rows += [(3 * i + j, " ".join(base[: 80 - j])) for j in range(r.choice((1, 2, 3)))]
    rows += [rows[0], rows[0], (None, rows[5][1]), (None, ""), (None, ""), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    comp, sizes = brute([(k, t) for k, (_, t) in enumerate(rows)], 5, 80)
    groups = {}
    for k, n in enumerate(sizes):
        if n:
            groups.setdefault(comp[k], []).append(rows[k])
    want = sorted([min(g, key=lambda x: (x[0] is None, x[0])) for g in groups.values()] + [x for x, n in zip(rows, sizes, strict=True) if not n], key=repr)
    for most in (jj.MOST_BROADCAST, 0):
        monkeypatch.setattr(jj, "MOST_BROADCAST", most)
        assert sorted(map(tuple, jj.deduplicate(docs).collect()), key=repr) == want
