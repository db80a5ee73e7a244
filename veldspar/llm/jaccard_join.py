"""N-gram Jaccard join by a token-group matrix. Exact up to 64-bit hashing of shingles and of sets.

Documents are sets of word shingles; two are linked when ``percent`` of their
union is shared. The result is each document's component of the link graph. The
graph's nodes are the distinct sets, numbered by a hash of their tokens; document
ids are only looked up for the result.

1. *Groups.* Two linked sets of sizes in one class differ in at most d tokens,
   so if tokens are dealt by hash to more than d parts, some part is equal in
   both. Each set writes a signature for each of its parts, with the number of them that
   a linked set shares at least: its parts that hold a token, less d. Two sets are joined
   if they share as many as both ask; by one phrase alone they aren't, else ever more texts
   would hang together by phrases as a corpus grows. Where over ``MANY`` sets share a
   signature they are joined into a star, without pairs. The components of all this are groups of similar
   documents, and no link leaves its group. Tokens far commoner than others are
   left out of the parts, else phrases that many documents share would join
   them all; sets that differ in d tokens differ in no more without those. A set that has
   too few parts without them writes those of all its tokens as well. A map task sends a
   signature that many of its documents share once, with its least node, so it stays small.
2. *Unions.* Large groups are cut into blocks of similar sets (those of one least
   token together), bounded in sets and tokens; each block stores the union of
   its tokens, as a map of bits beside the sets.
3. *Bounds.* For a query set Q and a block with union U, no member can pass
   |Q n U| / |Q|; a pair of blocks is opened only if some set reaches the
   threshold in the other's map and its size fits. What is joined for the bounds is one
   block's sets with many blocks' maps; the sets of both travel only after that.
4. *Opening.* Intersections in opened blocks are matrix products over the
   tokens that both sides have. A pair of blocks returns a spanning forest of
   its links, never the pairs.

Blocks of a large group are opened inside and against one pivot block first.
Those whose sets are by then all in the group's main component need no
comparison among themselves, so a group of near copies takes as many pairs of blocks as it
has blocks; only blocks that are not settled meet all others.

Copies (equal sets) are one node from the start: one of each enters 2 to 4.

Plan: two narrow passes over the text (sizes, set hashes and counts of tokens in
a fixed number of cells; signatures) and one over the texts of members of groups. What is
shuffled is about half a number for each word, packed as arrays, in buckets whose
number follows the counted signatures. A task holds one bucket, one block of signatures and
a bounded cache. Sums over a group and joins with them are dealt by group and salt, as
a group may hold any share of the rows; components are found by distributed contraction.

Defined results: a null or empty text, or one of white space, has an empty set
and links with nothing; a text with fewer words than a shingle is one shingle;
a very long text is one set like any other; ids that are no numbers are refused;
every row is a document of its own, whether its id is null or that of other rows
too; a component is named by its least id, with null if none of its rows has
one; an empty table gives an empty result; other columns are not read, and ``deduplicate``
passes them through, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import cut, discard, holding, pieces, require, spare, worker_cache

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
#: Signatures kept by a task before it sends them, sets and tokens of a block, signatures of a bucket.
FLUSH, BLOCK_SETS, BLOCK_TOKENS, BUCKET = 1 << 18, 256, 400_000, 1 << 19
#: Cells of the count of all tokens, and bits of a union's map (powers of two).
CELLS, BITS = 1 << 20, 1 << 20
#: Parts that a group of any size is dealt to for sums and joins; maps of blocks that travel together.
SALTS, MAPS = 256, 32
#: Sets that share a signature and are compared in pairs, at most; what a pair's shared signatures must add up to,
#: each with this over the number asked; the largest number asked, and what a set without enough parts writes (four bits travel).
MANY, ENOUGH, MOST_ASKED, NOTHING = 16, 1 << 20, 14, 15
#: Words of 64 marks each of the map of keys that a table is read by.
MARKS = 1 << 17
#: Ratio of the bounds of size classes, and times that tokens are dealt to parts anew.
RATIO, FORMS = 1.12, 6
#: Rows of (node, group, block) that may be broadcast, about 40 bytes each.
MOST_BROADCAST = 500_000


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ (x >> U(31)) ^ U(seed)) * _ODD
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) > 100_000:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


_HASHES = worker_cache(_WordHashes())


def token_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles (ASCII letters in lower case)."""
    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, U)
    h = np.fromiter(map(_HASHES.__getitem__, words), U, n)
    k = min(k, n)
    acc = np.full(n - k + 1, k, U)
    for i in range(k):
        acc = acc * _ODD + _mix(h[i : n - k + 1 + i], 0)
    return np.unique(_mix(acc, 1))


class Classes:
    """Size classes: bounds, largest differences and numbers of parts.

    Two linked sets meet in the class of the larger one, where the smaller writes too.
    Narrow classes keep the differences, and so the number of parts, low: a part of more
    tokens is less often equal by chance or by a phrase that two documents share.
    """

    def __init__(self, percent: int, largest: int = 1 << 40):
        low = [1]
        while low[-1] < largest:
            low.append(max(low[-1] + 1, int(low[-1] * RATIO)))
        self.percent, self.low = percent, np.array(low)
        self.differ = (100 - percent) * 2 * (self.low[1:] - 1) // (100 + percent)
        self.parts = np.where(self.differ == 0, 1, self.differ + np.maximum(3, self.differ // 8))

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, side="right") - 1

    def _reached(self, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of sets and a class they write to, each with its own first and then the next ones."""
        own, at, up = self.of(sizes), np.arange(len(sizes)), 0
        while len(at):
            yield at, own[at] + up
            up += 1
            at = at[100 * sizes[at] >= self.percent * self.low[own[at] + up]]

    def most_signatures(self, sizes: np.ndarray) -> np.ndarray:
        """About how many signatures sets of these sizes (1 at least) write at most."""
        out = np.zeros(len(sizes), np.int64)
        for at, c in self._reached(sizes):
            out[at] += self.parts[c]
        return out

    def signatures(self, sets: list[np.ndarray], nodes: np.ndarray, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(signature, node) of ``rated``."""
        return self.rated(sets, nodes, common)[:2]

    def rated(self, sets: list[np.ndarray], nodes: np.ndarray, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(signature, node, asked) of all parts of non-empty sets, in each class that they reach.

        ``asked`` is how many signatures of this class and form a linked set shares at least: a differing
        token spoils one part at most, so of f parts that hold a token f - d are equal in both. A set without
        enough parts writes ``NOTHING``: in this form it meets those that have enough, by what they ask.

        Tokens in cells marked ``common`` are left out of the parts: two sets that
        differ in d tokens differ in no more without them. A set with more than d parts
        that hold a token shares one of these with any set it is linked with. A set
        without so many also deals all its tokens to parts anew, ``FORMS`` times at most
        until there are enough, so it meets the other in the form in which one of them has enough
        (in the last form it writes empty parts too, where any two such sets meet).
        """
        sizes = np.array([len(s) for s in sets], np.int64)
        out = []

        def write(at: np.ndarray, c: np.ndarray, form: int) -> np.ndarray:
            """Adds the signatures of the sets at ``at`` in their class; which of these have too few parts."""
            parts, differ = self.parts[c], self.differ[c]
            base = np.cumsum(parts) - parts
            tokens, owner = np.concatenate([sets[i] for i in at]), np.repeat(np.arange(len(at)), sizes[at])
            if form == 0 and common is not None:
                rare = ~common[(tokens & U(CELLS - 1)).astype(np.int64)]
                tokens, owner = tokens[rare], owner[rare]
            slot = base[owner] + ((_mix(tokens, 2 + 16 * form) >> U(33)) % parts[owner].astype(U)).astype(np.int64)
            total = int(parts.sum())
            values = _mix(tokens, 3)
            halves = [np.bincount(slot, weights=(v & U(0xFFFFFFFF)).astype(float), minlength=total).astype(np.int64).astype(U) for v in (values, values >> U(32))]
            sums = halves[0] + (halves[1] << U(32))
            filled = np.bincount(slot, minlength=total) > 0
            doc = np.repeat(np.arange(len(at)), parts)
            few = np.add.reduceat(filled.astype(np.int64), base) <= differ
            keep = filled | few[doc] if form == FORMS else filled
            place = (np.repeat(c, parts).astype(U) << U(40)) + (np.arange(total) - np.repeat(base, parts)).astype(U)
            sig = _mix(sums + _mix(place, 4 + 16 * form), 5)
            asked = np.clip(np.add.reduceat(filled.astype(np.int64), base) - differ, 1, MOST_ASKED).astype(np.uint8)
            if form < FORMS:
                asked[few] = NOTHING
            out.append((sig[keep], nodes[at][doc[keep]], asked[doc[keep]]))
            return few

        for at, c in self._reached(sizes):
            for form in range(FORMS + 1):
                few = write(at, c, form)
                at, c = at[few], c[few]
                if not len(at):
                    break
        sig, node, asked = (np.concatenate(x) for x in zip(*out, strict=True))
        return sig, node, asked


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct pairs (node, leader), one in each row."""
    keep = a != b
    a, b = a[keep], b[keep]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
    return np.stack([a[fresh], b[fresh]], 1).astype("<i8")


def _groups(sig: np.ndarray, node: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of signature, each node once in it, and where the rows of each signature begin and end."""
    order = np.lexsort((asked, node, sig))
    sig, node, asked = sig[order], node[order], asked[order]
    fresh = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])][: len(sig)]
    sig, node, asked = sig[fresh], node[fresh], asked[fresh]
    starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]][: len(sig)])
    return sig, node, asked, starts, np.r_[starts[1:], len(sig)][: len(starts)]


def _stars(sig: np.ndarray, node: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows (signature, node, asked) to send, and the pairs (node, least node) of signatures that over ``MANY`` nodes share.

    These send their least node alone; 0 asked tells that it stands for many.
    """
    sig, node, asked, starts, ends = _groups(sig, node, asked)
    many = np.repeat(ends - starts > MANY, ends - starts)
    pairs = _forest(node[many], np.repeat(node[starts], ends - starts)[many])
    lead = np.zeros(len(sig), bool)
    lead[starts] = True
    keep = ~many | lead
    return sig[keep], node[keep], np.where(many, 0, asked)[keep].astype(np.uint8), pairs


def _met(sig: np.ndarray, node: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes (greater, least) that share signatures, and what these add up to, ``ENOUGH`` at most.

    The nodes of a signature that over ``MANY`` share, or that one stands for many in, are a star of enough each.
    """
    sig, node, asked, starts, ends = _groups(sig, node, asked)
    if not len(sig):
        return _forest(node, node), np.zeros(0, np.int64)
    sizes = ends - starts
    star = (sizes > MANY) | (np.minimum.reduceat(asked, starts) == 0)
    rows = np.repeat(star, sizes)
    a, b = [node[rows]], [np.repeat(node[starts], sizes)[rows]]
    score = [np.full(len(a[0]), ENOUGH, np.int64)]
    few = ~star & (sizes > 1)
    for step in range(1, int(sizes[few].max(initial=1))):
        at = starts[few & (sizes > step)]
        left = sizes[few & (sizes > step)] - step
        i = np.repeat(at - (np.cumsum(left) - left), left) + np.arange(left.sum())
        a.append(node[i + step])
        b.append(node[i])
        x, y = np.minimum(asked[i], asked[i + step]), np.maximum(asked[i], asked[i + step])
        need = np.where(y == NOTHING, x, y).astype(np.int64)
        score.append(np.where(need == NOTHING, 0, -(-ENOUGH // need)))
    a, b, score = np.concatenate(a), np.concatenate(b), np.concatenate(score)
    apart = a != b
    a, b, score = a[apart], b[apart], score[apart]
    order = np.lexsort((b, a))
    a, b, score = a[order], b[order], score[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)])
    total = np.minimum(np.add.reduceat(score, first), ENOUGH) if len(first) else score
    return np.stack([a[first], b[first]], 1), total


def _pairs_batch(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def set_node(s: np.ndarray) -> int:
    """The node of a token set: a hash of its tokens."""
    return int(_mix(s, 6).sum(dtype=U).astype(np.int64))


def _records(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Per row of docs (id, key, text): id, key, the node of its token set, its size n, its least token, signatures at most.

    Each task adds one row that has ``cells`` alone: its tokens, counted by ``CELLS`` cells.
    """
    names = ["id", "key", "node", "n", "least", "sigs", "cells"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding(_HASHES)
        cells, classes = np.zeros(CELLS, np.int64), Classes(percent)
        for batch in batches:
            for part in pieces(batch, 2):
                sets = [token_set(text, k) for text in part.column(2).to_pylist()]
                tokens = np.concatenate(sets)
                np.add.at(cells, (tokens & U(CELLS - 1)).astype(np.int64), 1)
                sizes = np.array([len(s) for s in sets], np.int64)
                sigs = np.where(sizes > 0, classes.most_signatures(np.maximum(sizes, 1)), 0)
                cols = [pa.array([set_node(s) for s in sets], pa.int64()), pa.array(sizes), pa.array([int(s[0] >> U(1)) if len(s) else 0 for s in sets], pa.int64()), pa.array(sigs)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols, pa.nulls(part.num_rows, pa.binary())], names=names)
        if cells.any():
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 6, pa.array([_packed(cells)], pa.binary())], names=names)

    return docs.mapInArrow(task, "id bigint, key bigint, node bigint, n bigint, least bigint, sigs bigint, cells binary")


def _packed(cells: np.ndarray) -> bytes:
    return zlib.compress(cells.astype("<i8").tobytes(), 1)


def _common(counts: DataFrame, tokens: int) -> np.ndarray:
    """Marks of the cells (of token hashes) that hold far more than their share of all tokens.

    ``counts`` (cells) has an array of ``CELLS`` counts for each task; they are added as
    they stream by, in two steps, and 16 sums are gathered. Passages and phrases that many
    documents share stand out, whatever the number of documents.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total += np.frombuffer(zlib.decompress(raw.as_py()), "<i8")
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([_packed(total)], pa.binary())], names=["cells"])

    for groups in (max(16, math.isqrt(tokens >> 22)), 16):
        counts = counts.repartition(groups, F.xxhash64("cells")).mapInArrow(add, "cells binary")
    cells = np.zeros(CELLS, np.int64)
    for row in counts.toLocalIterator():
        cells += np.frombuffer(zlib.decompress(row.cells), "<i8")
    mean = cells.mean()
    return cells > mean + max(8 * np.sqrt(mean), 8)


def _candidates(docs: DataFrame, k: int, percent: int, signatures: int, common: np.ndarray) -> DataFrame:
    """Pairs (a, b) of nodes of docs (text) whose components hold every link."""
    buckets = max(64, signatures // BUCKET + 1)
    packed = docs.sparkSession.sparkContext.broadcast(np.packbits(common))
    names = ["bucket", "sigs", "nodes", "asked"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding(_HASHES)
        classes, marks = Classes(percent), np.unpackbits(packed.value).astype(bool)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        seen: set[int] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            sig, node, asked, pairs = _stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            if len(pairs):
                # Pairs are done: buckets below 0 pass them on.
                yield pa.RecordBatch.from_arrays([pa.array([-1 - int(pairs[0, 0]) % buckets], pa.int64()), pa.array([b""]), pa.array([pairs.tobytes()]), pa.array([b""])], names=names)
            b = (sig % U(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            # Beside its bucket 32 bits of a signature travel: equal ones by chance bring pairs that are not linked, never lose any.
            sig, node, asked, b = (sig[order] // U(buckets)).astype("<u4"), node[order], asked[order], b[order]
            cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            ends = np.r_[cuts[1:], len(b)]
            for lo in range(0, len(cuts), 64):
                some = range(lo, min(len(cuts), lo + 64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b[cuts[lo : lo + 64]]), pa.array([sig[cuts[i] : ends[i]].tobytes() for i in some]), pa.array([node[cuts[i] : ends[i]].astype("<i8").tobytes() for i in some]), pa.array([_nibbles(asked[cuts[i] : ends[i]]) for i in some])],
                    names=names,
                )

        waiting = 0
        for batch in batches:
            for part in pieces(batch, 0):
                fresh: dict[int, np.ndarray] = {}
                for text in part.column(0).to_pylist():
                    found = token_set(text, k)
                    if len(found) and (node := set_node(found)) not in seen:
                        seen.add(node)
                        fresh[node] = found
                if len(seen) > 200_000:  # a set met again sends the same once more
                    seen.clear()
                if fresh:
                    held.append(classes.rated([*fresh.values()], np.array([*fresh], np.int64), marks))
                    waiting += len(held[-1][0])
                if waiting > FLUSH:
                    yield from flush()
                    waiting = 0
        if held:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []

        def ended() -> Iterator[pa.RecordBatch]:
            if held:
                pairs, score = _met(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(score)], names=["a", "b", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                bucket, own = batch.column(0)[i].as_py(), np.frombuffer(batch.column(2)[i].as_py(), "<i8")
                if bucket < 0:
                    own = own.reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(np.full(len(own), ENOUGH))], names=["a", "b", "score"])
                    continue
                if bucket != now:
                    yield from ended()
                    now = bucket
                held.append((np.frombuffer(batch.column(1)[i].as_py(), "<u4"), own, _asked(batch.column(3)[i].as_py(), len(own))))
        yield from ended()

    sent = docs.mapInArrow(send, "bucket bigint, sigs binary, nodes binary, asked binary")
    met = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "a bigint, b bigint, score bigint")
    return met.groupBy("a", "b").agg(F.sum("score").alias("score")).where(F.col("score") >= ENOUGH).select("a", "b")


def _nibbles(asked: np.ndarray) -> bytes:
    """Numbers up to 15, two in a byte."""
    even = np.append(asked, np.zeros(len(asked) % 2, np.uint8))
    return (even[::2] | even[1::2] << 4).astype(np.uint8).tobytes()


def _asked(raw: bytes, n: int) -> np.ndarray:
    two = np.frombuffer(raw, np.uint8)
    return np.stack([two & 15, two >> 4], 1).reshape(-1)[:n]


class Block:
    """Some sets, concatenated, and the union of their tokens."""

    def __init__(self, nodes: np.ndarray, sets: list[np.ndarray]):
        self.nodes, self.sizes = nodes, np.array([len(s) for s in sets], np.int64)
        self.tokens = np.concatenate(sets) if sets else np.zeros(0, U)
        self.union = np.unique(self.tokens)

    def pick(self, chosen: np.ndarray) -> Block:
        ends = np.cumsum(self.sizes)
        return Block(self.nodes[chosen], [self.tokens[ends[i] - self.sizes[i] : ends[i]] for i in chosen])

    def dump(self) -> bytes:
        return np.int64(len(self.nodes)).tobytes() + self.nodes.astype("<i8").tobytes() + self.sizes.astype("<i8").tobytes() + self.tokens.astype("<u8").tobytes()

    @staticmethod
    def load(raw: bytes) -> Block:
        n = int(np.frombuffer(raw[:8], "<i8")[0])
        nodes, sizes = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<i8", n, 8 + 8 * n)
        tokens = np.frombuffer(raw, "<u8", -1, 8 + 16 * n)
        return Block(nodes, np.split(tokens, np.cumsum(sizes)[:-1]) if n else [])

    def map(self) -> bytes:
        """The union's tokens, by ``BITS`` cells."""
        bits = np.zeros(BITS, bool)
        bits[(self.union & U(BITS - 1)).astype(np.int64)] = True
        return zlib.compress(np.packbits(bits).tobytes(), 1)

    def reaches(self, bits: np.ndarray, low: int, high: int, percent: int) -> bool:
        """Whether some set's overlap with a union's map lets it link with one of the sizes low to high."""
        doc = np.repeat(np.arange(len(self.nodes)), self.sizes)
        overlap = np.bincount(doc[bits[(self.tokens & U(BITS - 1)).astype(np.int64)]], minlength=len(self.nodes))
        fits = (100 * self.sizes >= percent * low) & (percent * self.sizes <= 100 * high)
        return bool((fits & (100 * overlap >= percent * self.sizes)).any())

    def bounded(self, other: Block, percent: int) -> np.ndarray:
        """Places of the sets whose overlap with the other block's union lets them link in it."""
        doc = np.repeat(np.arange(len(self.nodes)), self.sizes)
        at = np.minimum(np.searchsorted(other.union, self.tokens), len(other.union) - 1)
        overlap = np.bincount(doc[other.union[at] == self.tokens], minlength=len(self.nodes))
        fits = (100 * self.sizes >= percent * other.sizes.min()) & (percent * self.sizes <= 100 * other.sizes.max())
        return np.flatnonzero(fits & (100 * overlap >= percent * self.sizes))

    def shared(self, other: Block) -> np.ndarray:
        """Sizes of the intersections of all sets of both."""
        both = np.intersect1d(self.union, other.union, assume_unique=True)
        out = np.zeros((len(self.nodes), len(other.nodes)), np.float32)
        if not len(both):
            return out

        def placed(block: Block) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(both, block.tokens), len(both) - 1)
            keep = both[at] == block.tokens
            at, doc = at[keep], np.repeat(np.arange(len(block.nodes)), block.sizes)[keep]
            order = np.argsort(at, kind="stable")
            return at[order], doc[order]

        (xa, xd), (ya, yd) = placed(self), placed(other)
        step = 8192
        for lo in range(0, len(both), step):
            dense = []
            for at, doc, block in ((xa, xd, self), (ya, yd, other)):
                i, j = np.searchsorted(at, [lo, lo + step])
                m = np.zeros((len(block.nodes), min(step, len(both) - lo)), np.float32)
                m[doc[i:j], at[i:j] - lo] = 1
                dense.append(m)
            out += dense[0] @ dense[1].T
        return out

    def links(self, other: Block, percent: int) -> np.ndarray:
        """Which sets of both are linked."""
        n = self.shared(other).astype(np.int64)
        return 100 * n >= percent * (self.sizes[:, None] + other.sizes[None, :] - n)


def _spanning(nodes: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Pairs (node, least node) of the components of a symmetric matrix of links."""
    label = np.argsort(np.argsort(nodes, kind="stable"), kind="stable")
    by_rank = np.sort(nodes)
    big = len(nodes)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], big).min(1, initial=big))
        if (new == label).all():
            return _forest(nodes, by_rank[label])
        label = new


def _open(query: Block, group: Block, percent: int) -> np.ndarray:
    """Spanning pairs of the links between two blocks, opened as far as the bounds ask."""
    none = _forest(np.zeros(0, np.int64), np.zeros(0, np.int64))
    if query is group:
        return _spanning(query.nodes, query.links(query, percent)) if len(query.nodes) > 1 else none
    chosen = query.bounded(group, percent)
    if not len(chosen):
        return none
    q = query.pick(chosen)
    back = group.bounded(q, percent)
    if not len(back):
        return none
    g = group.pick(back)
    links = q.links(g, percent)
    n, m = links.shape
    whole = np.zeros((n + m, n + m), bool)
    whole[:n, n:], whole[n:, :n] = links, links.T
    return _spanning(np.r_[q.nodes, g.nodes], whole)


def _with_totals(rows: DataFrame, keys: list[str], **totals: tuple[Callable[[Column], Column], Column]) -> DataFrame:
    """``rows`` (node, ...) with totals over the groups of ``keys``, each group dealt to ``SALTS`` parts for the totals and the join."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(len(keys))), F.lit(SALTS)))
    parts = rows.groupBy(*keys, "salt").agg(*[f(c).alias(k) for k, (f, c) in totals.items()])
    over = Window.partitionBy(*keys)  # SALTS rows at most
    parts = parts.select(*keys, "salt", *[f(F.col(k)).over(over).alias(k) for k, (f, _) in totals.items()])
    return rows.join(parts, [*keys, "salt"]).drop("salt")


def _assigned(sets: DataFrame) -> DataFrame:
    """(node, key, comp, block, g) of sets (node, key, n, least, comp); g is what travels together. No text is touched.

    A group of one block has block null. A large group is dealt by least token, and
    what is still too large by hash.
    """
    blocks = lambda count, total: F.greatest(F.ceil(F.col(count) / BLOCK_SETS), F.ceil(F.col(total) / BLOCK_TOKENS)).cast("bigint")
    sets = cut(_with_totals(sets, ["comp"], size=(F.sum, F.lit(1)), total=(F.sum, F.col("n"))).where("size > 1").withColumn("blocks", blocks("size", "total")))
    # Small groups travel together, some thousand sets at a time.
    some = max(64, sets.count() // 2000)
    small = sets.where("blocks = 1").select("node", "key", "comp", F.lit(None).cast("bigint").alias("block"), F.pmod(F.xxhash64("comp"), F.lit(some)).alias("g"))
    large = sets.where("blocks > 1").withColumn("range", F.pmod(F.xxhash64("least"), F.col("blocks")))
    large = _with_totals(large, ["comp", "range"], here=(F.sum, F.lit(1)), tokens=(F.sum, F.col("n")))
    large = large.withColumn("block", F.xxhash64("range", F.pmod(F.xxhash64("node", F.lit(7)), blocks("here", "tokens"))))
    out = cut(small.unionByName(large.select("node", "key", "comp", "block", F.xxhash64("comp", "block").alias("g"))))
    discard(sets)
    return out


def _verified(docs: DataFrame, assigned: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Spanning pairs of all links inside the groups that ``assigned`` describes, and the table behind them."""
    # The members' texts are picked without a shuffle of all texts: by their table while it is small, else by a map of its keys.
    few = assigned.count() <= MOST_BROADCAST
    rows = (docs if few else _looked_up(docs, assigned, "key")[0]).join(F.broadcast(assigned) if few else assigned, "key").select("node", "comp", "block", "g", "text")
    schema = pa.schema([(c, pa.binary() if c in ("raw", "map") else pa.int64()) for c in ("a", "b", "comp", "block", "low", "high", "raw", "map")])

    def open_blocks(table: pa.Table) -> pa.Table:
        by: dict[tuple[int, int | None], dict[int, np.ndarray]] = {}
        for comp, node, text, block in zip(*(table.column(c).to_pylist() for c in ("comp", "node", "text", "block")), strict=True):
            found = token_set(text, k)
            # Rows of one id and text come more than once.
            if set_node(found) == node:
                by.setdefault((comp, block), {})[node] = found
        out = []
        for (comp, block), rows in by.items():
            b = Block(np.array([*rows], np.int64), [*rows.values()])
            large = block is not None
            out += [{"a": x, "b": y, "comp": comp if large else None} for x, y in _open(b, b, percent).tolist()]
            if large:
                out.append({"comp": comp, "block": block, "low": int(b.sizes.min()), "high": int(b.sizes.max()), "raw": b.dump(), "map": b.map()})
        return pa.Table.from_pylist(out, schema=schema)

    kind = ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'bigint'}" for f in schema)
    opened = cut(rows.groupBy("g").applyInArrow(open_blocks, kind))
    inside = opened.where("a is not null").select("a", "b")
    kept = opened.where("raw is not null").drop("a", "b")
    if kept.isEmpty():
        return inside, opened
    return inside.unionByName(_across(kept, opened.where("a is not null and comp is not null").select("a", "b"), assigned, percent)), opened


def _across(kept: DataFrame, inside: DataFrame, assigned: DataFrame, percent: int) -> DataFrame:
    """Spanning pairs between the blocks of large groups: ``kept`` (comp, block, low, high, raw, map), with the links ``inside`` them."""

    def open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, g = (Block.load(batch.column(c)[i].as_py()) for c in (0, 1))
                yield _pairs_batch(_open(q, g, percent))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                comp, block, q = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), Block.load(batch.column(2)[i].as_py())
                others = []
                for m in batch.column(3)[i].as_py():
                    if m["settled"] or m["block"] > block:
                        bits = np.unpackbits(np.frombuffer(zlib.decompress(m["map"]), "u1")).astype(bool)
                        if q.reaches(bits, m["low"], m["high"], percent):
                            others.append(m["block"])
                yield pa.RecordBatch.from_arrays([pa.array([comp] * len(others), pa.int64()), pa.array([block] * len(others), pa.int64()), pa.array(others, pa.int64())], names=["comp", "block", "other"])

    raw = lambda place, name: kept.select("comp", F.col("block").alias(place), F.col("raw").alias(name))
    places = cut(_with_totals(kept.select("comp", "block", F.col("block").alias("node")), ["comp"], blocks=(F.sum, F.lit(1)), pivot=(F.min, F.col("block"))).drop("node"))
    # All blocks against their group's pivot, of which SALTS copies travel at most.
    some = F.least(F.lit(SALTS), F.col("blocks"))
    pivots = places.where("block = pivot").join(raw("block", "q"), ["comp", "block"]).select("comp", "q", F.explode(F.sequence(F.lit(0).cast("bigint"), some - 1)).alias("salt"))
    others = places.where("block <> pivot").withColumn("salt", F.pmod(F.xxhash64("block"), some)).join(raw("block", "g"), ["comp", "block"])
    first = cut(others.join(pivots, ["comp", "salt"]).select("q", "g").mapInArrow(open_pairs, "a bigint, b bigint"))
    # A block is settled if all its sets are in one component by now, the one that most such blocks of the group are in.
    labels = components(inside.unionByName(first))
    sets = assigned.where("block is not null").join(labels, "node", "left").select("comp", "block", F.expr("coalesce(component, node)").alias("label"))
    state = sets.groupBy("comp", "block").agg(F.min("label").alias("label"), (F.min("label") == F.max("label")).alias("whole")).withColumn("node", F.col("block"))
    state = _with_totals(state, ["comp", "label"], alike=(F.sum, F.col("whole").cast("int")))
    state = _with_totals(state, ["comp"], most=(F.max, F.struct("alike", "label")))
    state = places.join(state.select("comp", "block", (F.col("whole") & (F.col("most.label") == F.col("label"))).alias("settled")), ["comp", "block"]).where("block <> pivot")
    state = cut(state.withColumn("chunks", F.ceil(F.col("blocks") / MAPS)))
    # Blocks that aren't settled against all others: the bounds first, then the sets.
    maps = state.join(kept, ["comp", "block"]).select("comp", F.pmod(F.xxhash64("block"), F.col("chunks")).alias("chunk"), F.struct("block", "settled", "low", "high", "map").alias("m"))
    maps = maps.groupBy("comp", "chunk").agg(F.collect_list("m").alias("maps"))
    queries = state.where("not settled").select("comp", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"))
    queries = queries.join(raw("block", "q"), ["comp", "block"]).join(maps, ["comp", "chunk"]).select("comp", "block", "q", "maps")
    reached = cut(queries.mapInArrow(bounds, "comp bigint, block bigint, other bigint"))
    met = reached.join(raw("block", "q"), ["comp", "block"]).join(raw("other", "g"), ["comp", "other"]).select("q", "g")
    out = cut(first.unionByName(met.mapInArrow(open_pairs, "a bigint, b bigint")))
    for table in (places, first, labels, state, reached):
        discard(table)
    return out


def _once(rows: DataFrame, records: DataFrame, text_col: str, key: str = "key") -> DataFrame:
    """``rows``, with an id and text (``key``) that very many of them share taken once, before any are dealt by key."""
    copies = records.groupBy(key).agg(F.count("*").alias("copies")).where(F.col("copies") > max(1000, records.count() // 10_000))
    hot = F.broadcast(copies.select(key))
    return rows.join(hot, key, "left_anti").unionByName(rows.join(hot, key, "left_semi").dropDuplicates([key, text_col]))


def _linked(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, key, node, n, least) of each row, and (node, c, first) of each set that is not empty.

    c is the set's component; first has the least (no_id, id, key) of its rows.
    """
    require(docs, id_col, text_col)
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), _key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    written = cut(_records(rows, words, percent))
    records = written.where("cells is null").select("id", "key", "node", "n", "least", "sigs")
    tokens, signatures = (x or 0 for x in records.agg(F.sum("n"), F.sum("sigs")).first())
    common = _common(written.where("cells is not null").select("cells"), tokens)
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key"))
    classes = cut(records.where("n > 0").groupBy("node").agg(first.alias("first"), F.max("n").alias("n"), F.min("least").alias("least")))
    rough = components(_candidates(rows.select("text"), words, percent, signatures, common))
    assigned = _assigned(rough.withColumnRenamed("component", "comp").join(classes.select("node", "first.key", "n", "least"), "node"))
    pairs, behind = _verified(_once(rows.select("key", "text"), records, "text"), assigned, words, percent)
    found = components(pairs)
    for table in (rough, assigned, behind):
        discard(table)
    return records, classes.join(found, "node", "left").select("node", F.expr("coalesce(component, node)").alias("c"), "first")


def _looked_up(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: those whose key may be among ``keys`` (all that are, and a few more), and the others.

    Keys are marked in a map of ``MARKS`` words, which alone is sent to the rows; so the others' texts aren't shuffled.
    """
    word = lambda c: F.pmod(F.shiftrightunsigned(F.col(c), 6), F.lit(MARKS))
    mark = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.col(c), F.lit(64)).cast("int"))
    at, marks = spare(rows, "word"), spare(rows, "marks")
    words = keys.select(word(key).alias(at), mark(key).alias("one")).groupBy(at).agg(F.bit_or("one").alias(marks))
    rows, names = rows.withColumn(at, word(key)).join(F.broadcast(words), at, "left"), rows.columns
    hit = F.coalesce(F.col(marks).bitwiseAND(mark(key)) != 0, F.lit(False))
    return rows.where(hit).select(*names), rows.where(~hit).select(*names)


def _key(id_col: str, text_col: str) -> Column:
    """Hash of id and text."""
    return F.xxhash64(F.col(id_col).cast("bigint"), F.col(text_col))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id."""
    records, sets = _linked(docs, id_col, text_col, words, percent)
    least = sets.groupBy("c").agg(F.min("first")["id"].alias("component_id"))
    named = records.where("n > 0").join(sets.join(least, "c").select("node", "component_id"), "node")
    out = [named.select("id", "n", "component_id"), records.where("n = 0").select("id", "n", F.col("id").alias("component_id"))]
    return out[0].unionByName(out[1]).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, or one without an id if none has one.

    Of several rows of that id, or without one, the one whose text has the least hash stays.
    Rows without words are kept, whatever their id. All columns stay.
    """
    names = docs.columns
    records, sets = _linked(docs, id_col, text_col, words, percent)
    kept = sets.groupBy("c").agg(F.min("first")["key"].alias("key"))
    key = spare(docs, "key")
    wordless = ~F.rlike(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
    rows = docs.where(~wordless).withColumn(key, _key(id_col, text_col))
    records, kept = (t.withColumnRenamed("key", key) for t in (records, kept))
    # Rows whose key is kept and no other row's stay as they are; what else there is goes through the join.
    own = records.where("n > 0").groupBy(key).agg(F.count("*").alias("__n"))
    own = own.where("__n > 1").select(key).unionByName(own.select(key).join(kept, key, "left_anti"))
    rows, alone = _looked_up(rows, own, key)
    full = _once(rows, records, text_col, key).join(kept, key, "left_semi")
    # By id and text as well: of two texts whose keys are equal by chance both stay.
    full = full.withColumn(place := spare(full, "row"), F.row_number().over(Window.partitionBy(key, id_col, text_col).orderBy(text_col))).where(F.col(place) == 1)
    return full.select(*names).unionByName(alone.select(*names)).unionByName(docs.where(wordless).select(*names))
