"""Benchmark decontamination with a generalised suffix automaton.

The benchmark's items are normalised to words and put into one suffix automaton
(bounded: see ``MAX_SHARD_WORDS``). Documents stream their words through it;
after each word the automaton gives the longest suffix of what was read that
occurs in any item. Every word inside an occurrence of a *window* (``window``
consecutive item words, or a whole item that is shorter) is hit.

Plan: one narrow pass over the documents without a shuffle or a copy. The benchmark is
dealt into shards of about ``max_shard_words`` words by a prefix sum over blocks whose
number follows its size. The driver makes an automaton of each shard, one after the other, and flattens it to
arrays of some 60 bytes a word, beside the vocabulary. They are broadcast variables of their own;
a task reads them from its executor's files one after the other for each batch of texts, so its
memory holds one of them, however large the benchmark.

Defined results: a null or empty text has no words and no hits and stays as it
is; a null or empty item has no windows; repeated documents are
treated one by one and repeated items once; a null item id
is written ``null``; very long texts are read whole; empty tables give empty results or no
hits. Columns besides id and text pass through untouched, whatever their names.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, discard, holding, require, spare

#: Words are runs of ASCII letters and digits and of all characters beyond ASCII.
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: What a text's hits are: words, merged spans of words and their characters, ids of the items.
HITS = "struct<n_words: bigint, spans: array<struct<start: bigint, end: bigint, first: bigint, last: bigint>>, items: array<string>>"
#: Bound of what is gathered and broadcast: an automaton of n words has fewer than 2n states and 3n transitions.
MAX_SHARD_WORDS = 250_000


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.translate(LOWER)) if text else []


class SuffixAutomaton:
    """All substrings (of words) of the items given, with the items that hold each window.

    It is made with a dictionary for each state and kept as arrays: the transitions of
    state v are ``words`` and ``to`` from ``first[v]`` to ``first[v + 1]``, by word number.
    """

    def __init__(self, items: list[tuple[str, list[str]]], window: int):
        self.window = window
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = array("i", [-1]), array("i", [0])
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        n = len(self.next)
        # The state of the suffix of ``window`` words of a state's string: itself or an ancestor.
        self.cut = array("i", [-1]) * n
        order = sorted(range(n), key=self.length.__getitem__)
        for v in order[1:]:
            if self.length[v] >= window:
                up = self.link[v]
                self.cut[v] = self.cut[up] if self.length[up] >= window else v
        self.items = list(dict.fromkeys(item for item, _ in items))
        number = {item: k for k, item in enumerate(self.items)}
        holders: set[tuple[int, int]] = set()
        whole: dict[int, set[tuple[int, str]]] = defaultdict(set)
        for item, words in items:
            if 0 < len(words) < window:
                v = 0
                for w in words:
                    v = self.next[v][w]
                whole[v].add((len(words), item))
            else:
                v = length = 0
                for w in words:
                    v, length = self._step(v, length, w)
                    if length >= window:
                        holders.add((self.cut[v], number[item]))
        # Items of each window's state, from held[v] to held[v + 1].
        held = [0] * (n + 1)
        for v, _ in holders:
            held[v + 1] += 1
        for v in range(n):
            held[v + 1] += held[v]
        self.held, self.holders = array("i", held), array("i", [k for _, k in sorted(holders)])
        # Short items that end where a state's string ends: its own, then those of the state that ``short`` tells.
        self.whole = {v: tuple(sorted(x)) for v, x in whole.items()}
        self.short = array("i", [0]) * n
        for v in order[1:]:
            self.short[v] = v if v in whole else self.short[self.link[v]]
        self.vocabulary = {w: k for k, w in enumerate(self.next[0])}
        self.first, self.words, self.to = array("i", [0]), array("i"), array("i")
        for moves in self.next:
            for k, v in sorted((self.vocabulary[w], v) for w, v in moves.items()):
                self.words.append(k)
                self.to.append(v)
            self.first.append(len(self.to))
        del self.next

    def _extend(self, last: int, w: str) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(w)
        if known is not None:
            if length[known] == length[last] + 1:
                return known
            return self._clone(last, known, w)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
        return cur

    def _clone(self, p: int, q: int, w: str) -> int:
        nxt, link, length = self.next, self.link, self.length
        made = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = made
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = made
            p = link[p]
        return made

    def _step(self, v: int, length: int, w: str) -> tuple[int, int]:
        """State and longest matching length after one more word."""
        nxt = self.next
        to = nxt[v].get(w)
        while to is None:
            v = self.link[v]
            if v == -1:
                return 0, 0
            length = self.length[v]
            to = nxt[v].get(w)
        return to, length + 1

    def scan(self, words: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged hit spans [start, end) in words, and the items with occurring windows."""
        window, link, lengths, cut_of, short = self.window, self.link, self.length, self.cut, self.short
        first, moves, to = self.first, self.words, self.to
        spans: list[tuple[int, int]] = []
        states: set[int] = set()
        items: set[str] = set()
        v = length = 0
        for i, w in enumerate(map(self.vocabulary.get, words)):
            if w is None:
                v = length = 0
                continue
            # The root has a move for every word, at its number's place.
            while v:
                end = first[v + 1]
                k = bisect_left(moves, w, first[v], end)
                if k < end and moves[k] == w:
                    v = to[k]
                    length += 1
                    break
                v = link[v]
                length = lengths[v]
            else:
                v, length = to[w], 1
            if length >= window:
                states.add(cut_of[v])
                start = i + 1 - window
                if spans and start <= spans[-1][1]:
                    spans[-1] = (min(start, spans[-1][0]), i + 1)
                else:
                    spans.append((start, i + 1))
            s = short[v]
            while s:
                for n, item in self.whole[s]:
                    if n <= length:
                        items.add(item)
                        spans.append((i + 1 - n, i + 1))
                s = short[link[s]]
        for s in states:
            items.update(self.items[k] for k in self.holders[self.held[s] : self.held[s + 1]])
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _shards(benchmark: DataFrame, item_col: str, text_col: str, window: int, most: int) -> Iterator[list[tuple[str, list[str]]]]:
    """The items' words, about ``most`` at a time on the driver.

    Shards follow prefix sums of lengths, taken over blocks (by hash) of about a 16th of a
    shard each. An item is cut into pieces of no more than that, which overlap by
    ``window`` - 1 words, which keeps its windows; equal pieces count once.
    """

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: words_of(t))

    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), split(F.col(text_col)).alias("words")).where("size(words) > 0")
    long = max(most // 16, 2 * window)
    items = items.withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - F.lit(window)), F.lit(long)))).select("item", F.expr(f"slice(words, at + 1, {long + window - 1})").alias("words"))
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    if total <= most:
        if total:
            yield [(r.item, r.words) for r in items.collect()]
        return
    items = cut(items.distinct().withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(16 * (total // most + 1)))))
    blocks = items.groupBy("block").agg(F.sum(F.size("words")).alias("n"))
    starts = cut(blocks.withColumn("shard", F.floor((F.sum("n").over(Window.orderBy("block")) - F.col("n")) / F.lit(most))))
    for (shard,) in starts.select("shard").distinct().orderBy("shard").collect():
        chosen = [r.block for r in starts.where(F.col("shard") == shard).collect()]
        yield [(r.item, r.words) for r in items.where(F.col("block").isin(chosen)).collect()]
    discard(items)
    discard(starts)


def _rows(texts: Sequence[str | None], automata: Sequence[Broadcast]) -> list[tuple[int, list[dict], list[str]]]:
    """What ``HITS`` has of each text. One text's words are held at a time, and split again for each of several automata."""
    sizes = [0] * len(texts)
    spans: list[list] = [[] for _ in texts]
    names: list[set] = [set() for _ in texts]
    if not automata:
        sizes = [len(words_of(text)) for text in texts]
    for shared in automata:
        automaton = shared.value
        for i, text in enumerate(texts):
            own = words_of(text)
            found, ids = automaton.scan(own)
            sizes[i] = len(own)
            spans[i] += found
            names[i] |= ids
        if len(automata) > 1:
            del automaton
            shared.__dict__.pop("_value", None)  # read again for the next batch
    rows = []
    for text, n, found, ids in zip(texts, sizes, spans, names, strict=True):
        found = found if len(automata) < 2 else merged(found)
        at = [m.span() for m in WORDS.finditer(text.translate(LOWER))] if found else []
        rows.append((n, [{"start": a, "end": b, "first": at[a][0], "last": at[b - 1][1]} for a, b in found], sorted(ids)))
    return rows


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    max_shard_words: int = MAX_SHARD_WORDS,
    hits_col: str = "_hits",
) -> DataFrame:
    """``docs`` with one more column, named ``hits_col``.

    It is ``struct<n_words, spans: array<struct<start, end, first, last>>, items:
    array<string>>``: the text's words, the merged hit spans in words (end
    exclusive) and characters, and the ids of items with windows in it.
    """
    require(docs, text_col)
    require(benchmark, item_col, item_text_col)
    sc = docs.sparkSession.sparkContext
    automata = []
    for shard in _shards(benchmark, item_col, item_text_col, window, max_shard_words):
        automata.append(sc.broadcast(SuffixAutomaton(shard, window)))
        if len(automata) > 1:  # files hold them from now on
            for shared in automata[-2:]:
                shared.__dict__.pop("_value", None)

    @F.pandas_udf(T._parse_datatype_string(HITS))
    def scan(texts: pd.Series) -> pd.DataFrame:
        holding(None)
        return pd.DataFrame(_rows(texts, automata), columns=["n_words", "spans", "items"])

    # Otherwise a filter on the result would make Spark run the scan twice.
    return docs.withColumn(hits_col, scan.asNondeterministic()(F.col(text_col)))


def hit_report(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: id, n_words, hit spans, n_hit (words in them), items."""
    require(docs, id_col, text_col)
    found = find_hits(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, text_col="text", **options)
    covered = F.expr(
        "aggregate(array_sort(_hits.spans), named_struct('n', 0L, 'to', 0L),"
        " (a, s) -> named_struct('n', a.n + greatest(0L, s.end - greatest(s.start, a.to)), 'to', greatest(a.to, s.end)), a -> a.n)"
    )
    return found.select(
        "doc_id", F.col("_hits.n_words").alias("n_words"), F.col("_hits.spans").alias("spans"), covered.alias("n_hit"), F.array_sort("_hits.items").alias("items")
    )


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    max_coverage: float = 0.5,
    count_col: str | None = None,
    **options,
) -> DataFrame:
    """Cut hit spans out of the texts; documents mostly made of them go.

    A document whose hit words exceed ``max_coverage`` of its words is dropped.
    From the others the spans go, with the characters between their words, and
    one space stands for each. Texts without hits stay byte for byte. All
    columns stay; ``count_col``, if given, gets the new number of characters.
    """
    require(docs, text_col)
    names = docs.columns
    hits, new = spare(docs, "_hits"), spare(docs, "_new")
    found = find_hits(docs, benchmark, text_col=text_col, hits_col=hits, **options)
    h, text = f"`{hits}`", f"`{text_col}`"
    covered = F.expr(f"aggregate({h}.spans, 0L, (n, s) -> n + s.end - s.start)")
    # The texts before each span and after the last one, in one pass over the spans.
    pieces = F.expr(
        f"aggregate({h}.spans, named_struct('at', 0L, 'out', cast(array() as array<string>)),"
        f" (a, s) -> named_struct('at', s.last, 'out', array_append(a.out, rtrim(substring({text}, int(a.at) + 1, int(s.first - a.at))))),"
        f" a -> array_append(a.out, ltrim(substring({text}, int(a.at) + 1))))"
    )
    hit = F.size(f"{hits}.spans") > 0
    out = found.where(~hit | (covered <= F.lit(float(max_coverage)) * F.col(f"{hits}.n_words")))
    out = out.withColumn(new, F.when(hit, F.array_join(pieces, " ")))
    out = out.withColumn(text_col, F.when(hit, F.col(new)).otherwise(F.col(text_col)))
    if count_col:
        out = out.withColumn(count_col, F.when(hit, F.length(text_col).cast("bigint")).otherwise(F.col(count_col)))
    return out.select(*names)
