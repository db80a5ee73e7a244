"""Token counts by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens that no merge can cross. The distinct pre-tokens
of a batch are held as one ragged numpy array of symbols; in every round each
sequence's lowest-ranked pair is merged in all sequences at once, until none is
left, and the surviving symbols are counted. A rank whose product only takes
part in later ranks is applied at all its places in a sequence in one round
(that is what one place at a time would come to); any other rank at the
leftmost place alone. Symbols outside the vocabulary count one for each UTF-8
byte, as byte fallback does.

A pre-token of more than ``LONG`` symbols would take a round for each rank that
occurs in it, so its places are kept by rank: a round looks at the lowest rank's places
alone, and a merge looks up the two new pairs. Its work follows its length.

Counts of pre-tokens are remembered up to a bound. One narrow pass, no shuffle.

Defined results: a null text is empty and has 0 bytes and tokens; very long texts and
words are counted whole; of equal ranks the leftmost place goes first; repeated rows
and further columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Numbered, holding, pieces, require, worker_cache

NONE = np.iinfo(np.int64).max
#: Symbols of a pre-token above which its places are kept by rank.
LONG = 256


class PieceMerger:
    """Counts as a sentencepiece BPE model with byte fallback gives them."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.library = sp
        pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i))]
        self.chars = {p: k for k, p in enumerate(dict.fromkeys(c for p, _ in pieces for c in p))}
        known = {p for p, _ in pieces}
        # Symbols: single characters first, then longer pieces.
        symbols = dict(self.chars)
        for p, _ in pieces:
            symbols.setdefault(p, len(symbols))
        ordered = sorted({-s for p, s in pieces if len(p) > 1})
        rank_of = {s: r for r, s in enumerate(ordered)}
        pairs = []
        for p, score in pieces:
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                if (a in known or len(a) == 1) and (b in known or len(b) == 1):
                    pairs.append((symbols[a], symbols[b], rank_of[-score], symbols[p]))
        self.n = len(symbols) + 1  # the last stands for any other character
        self.other = self.n - 1
        table = np.array(sorted(pairs), np.int64).reshape(-1, 4)
        self.keys, self.ranks, self.products = table[:, 0] * self.n + table[:, 1], table[:, 2], table[:, 3]
        # A rank is safe if no pair that holds its product has the same or a lower rank.
        first = np.full(self.n, NONE)
        np.minimum.at(first, table[:, 0], table[:, 2])
        np.minimum.at(first, table[:, 1], table[:, 2])
        self.safe = np.ones(len(ordered) + 1, bool)
        self.safe[self.ranks[first[self.products] <= self.ranks]] = False
        single = np.bincount(self.ranks, minlength=len(ordered) + 1)
        made = {}
        for r, p in zip(self.ranks.tolist(), self.products.tolist(), strict=True):
            made.setdefault(r, set()).add(p)
        for r, ps in made.items():
            if len(ps) > 1 or single[r] == 0:
                self.safe[r] = False
        # Cost of a single character that stays: 1, or its bytes if it is no piece.
        self.cost = np.ones(self.n, np.int64)
        for c, k in self.chars.items():
            if c not in known:
                self.cost[k] = len(c.encode())
        inside = {c for p, _ in pieces if len(p) > 1 for c in p}
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in inside)
        if any(re.search("[^▁]▁", p) for p, _ in pieces):
            self.split = re.compile(".+", re.S)  # a piece crosses words: nothing can be cut
        else:
            self.split = re.compile(f"▁*[^▁{alone}]+|▁+" + (f"|[{alone}]" if alone else ""))
        self.words, self.counts = Numbered(), np.zeros(0, np.int64)

    def normalised(self, text: str) -> str:
        """The model's own form of a text: ``sentencepiece`` does it where it is more than marking spaces."""
        return self.library.normalize(text)

    def merge(self, words: list[str]) -> np.ndarray:
        """Numbers of surviving symbols (or bytes) of each sequence."""
        lengths = np.array([len(w) for w in words], np.int64)
        long = np.flatnonzero(lengths > LONG)
        if len(long):
            total = np.zeros(len(words), np.int64)
            total[long] = [self.merge_long(words[i]) for i in long]
            short = np.flatnonzero(lengths <= LONG)
            total[short] = self.merge([words[i] for i in short])
            return total
        total = np.zeros(len(words), np.int64)
        if not words:
            return total
        sym, rest = self._symbols("".join(words))
        seq = np.repeat(np.arange(len(words)), lengths)
        while len(sym):
            key = sym[:-1] * self.n + sym[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            rank = np.where((self.keys[at] == key) & (seq[:-1] == seq[1:]), self.ranks[at], NONE) if len(self.keys) else np.full(len(key), NONE)
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            # A sequence's last symbol has no pair: NONE stands for it.
            best = np.minimum.reduceat(np.r_[rank, NONE], starts)
            open_ = best != NONE
            run = np.diff(np.r_[starts, len(sym)])
            if not open_.all():  # ended sequences leave
                ended = np.repeat(~open_, run)
                total += np.bincount(seq[ended], weights=rest[ended], minlength=len(words)).astype(np.int64)
                keep = ~ended
                rank = np.r_[rank, NONE][keep][:-1] if keep.any() else rank[:0]
                at = np.r_[at, 0][keep][:-1] if keep.any() else at[:0]
                sym, seq, rest = sym[keep], seq[keep], rest[keep]
                best, run = best[open_], run[open_]
                if not len(sym):
                    break
            own = np.repeat(best, run)[:-1]
            hit = np.flatnonzero(rank == own)
            # Left to right without overlap: in a run of neighbouring places, every other one.
            fresh = np.r_[True, np.diff(hit) != 1]
            first = np.maximum.accumulate(np.where(fresh, hit, 0))
            hit = hit[(hit - first) % 2 == 0]
            # Where a rank isn't safe, only the leftmost place.
            leftmost = np.r_[True, seq[hit][1:] != seq[hit][:-1]]
            hit = hit[leftmost | self.safe[rank[hit]]]
            sym[hit] = self.products[at[hit]]
            rest[hit] = 1
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, seq, rest = sym[keep], seq[keep], rest[keep]
        return total

    def _symbols(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The symbol of each character, and what it counts if it stays alone."""
        sym = np.array([self.chars.get(c, self.other) for c in text], np.int64)
        rest = np.array([1 if c in self.chars else len(c.encode()) for c in text], np.int64) if (sym == self.other).any() else np.ones(len(text), np.int64)
        return sym, np.where(sym == self.other, rest, self.cost[sym])

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or NONE) and product of each pair of symbols."""
        key = a * self.n + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == key
        return np.where(known, self.ranks[at], NONE), np.where(known, self.products[at], -1)

    def merge_long(self, word: str) -> int:
        """The number of surviving symbols (or bytes) of one long sequence.

        A symbol is known by its first character's place; ``after`` and ``before`` are
        its neighbours' places.
        """
        sym, rest = self._symbols(word)
        n = len(sym)
        if not len(self.keys):
            return int(rest.sum())
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank, product = np.full(n, NONE), np.full(n, -1)
        rank[:-1], product[:-1] = self._pairs(sym[:-1], sym[1:])
        places: dict[int, list[np.ndarray]] = defaultdict(list)
        queue: list[int] = []

        def put(at: np.ndarray) -> None:
            at = at[rank[at] != NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            cuts = np.flatnonzero(np.diff(rank[at])) + 1
            for part in np.split(at, cuts) if len(at) else ():
                r = int(rank[part[0]])
                if r not in places:
                    heapq.heappush(queue, r)
                places[r].append(part)

        put(np.arange(n))
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if not self.safe[r]:
                self._one_by_one(r, at.tolist(), sym, rest, after, before, rank, product, put)
                continue
            # In a run of neighbouring places, every other one from the left.
            fresh = np.r_[True, after[at[:-1]] != at[1:]]
            order = np.arange(len(at))
            at = at[(order - np.maximum.accumulate(np.where(fresh, order, 0))) % 2 == 0]
            gone = after[at]
            sym[at], rest[at], rest[gone], rank[gone] = product[at], 1, 0, NONE
            after[at] = after[gone]
            right = at[after[at] < n]
            before[after[right]] = right
            rank[at] = NONE
            changed = np.unique(np.r_[right, before[at][before[at] >= 0]])
            rank[changed], product[changed] = self._pairs(sym[changed], sym[after[changed]])
            put(changed)
        return int(rest.sum())

    def _one_by_one(self, r: int, at: list[int], sym, rest, after, before, rank, product, put) -> None:
        """Merges of rank r and below from the left, until there is none, in a sequence without any below r at first."""
        queue, other = [(r, i) for i in at], []
        n = len(sym)
        while queue:
            now, i = heapq.heappop(queue)
            if rank[i] != now:
                continue
            gone = int(after[i])
            sym[i], rest[i], rest[gone], rank[gone], rank[i] = product[i], 1, 0, NONE, NONE
            after[i] = to = int(after[gone])
            if to < n:
                before[to] = i
            changed = [k for k in (int(before[i]), i) if k >= 0 and after[k] < n]
            for k in changed:
                key = int(sym[k]) * self.n + int(sym[after[k]])
                at = int(self.keys.searchsorted(key))
                known = at < len(self.keys) and self.keys[at] == key
                rank[k], product[k] = (self.ranks[at], self.products[at]) if known else (NONE, -1)
                if rank[k] <= r:
                    heapq.heappush(queue, (int(rank[k]), k))
                else:
                    other.append(k)
        put(np.unique(np.array(other, np.int64)))

    def _settle(self, new: list[str]) -> None:
        self.counts = np.r_[self.counts, self.merge(new)]

    def count(self, texts: list[str | None]) -> list[int]:
        cut = [self.words.numbers(self.split.findall(self.normalised(t))) if t else [] for t in texts]
        self.words.settle(self._settle)
        out = [int(self.counts[np.array(numbers, np.int64)].sum()) for numbers in cut]
        if self.words.full():
            self.words.trim()
            self.counts = self.counts[:0]
        return out


_MERGERS: dict[str, PieceMerger] = worker_cache({})


def merger(path: str) -> PieceMerger:
    holding(_MERGERS)
    if path not in _MERGERS:
        _MERGERS[path] = PieceMerger(path)
    return _MERGERS[path]


def count_tokens(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    ``model`` is the path of a sentencepiece BPE model that every executor has.
    """
    require(docs, id_col, text_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(model)
        for batch in batches:
            for part in pieces(batch, 1, rows=256):
                n = pa.array(m.count(part.column(1).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), n, part.column(2)], names=["doc_id", "n_tokens", "n_bytes"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.octet_length("text").cast("bigint").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(task, f"doc_id {kind}, n_tokens bigint, n_bytes bigint")
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
