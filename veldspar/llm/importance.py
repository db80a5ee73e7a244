"""Importance resampling towards a target's distribution of hashed n-grams.

Features of a text are its runs of 1 to 3 words, each hashed to a bucket. A bucket weighs the
logarithm of its share in the target over its share in the corpus; a text weighs the
sum over its features, and adding a Gumbel number drawn from its id makes the highest
scores a sample without replacement.

Hashing goes by suffix arrays of word ids. A task numbers the words of a chunk of its
texts and sorts the chunk's suffixes by their first words. Where neighbours share n words
(the LCP is n at least) they form a run of one n-gram: it is hashed once, and its bucket is
scattered back to all its places. The hash of a longer run extends that of the shorter one
by a table of what so many bytes do to a checksum, so whole arrays of runs are hashed at once.

Texts are read once. Buckets of each text are kept in a table (2 bytes a feature); from it
come the counts by bucket, which tasks sum before they are shuffled, and the weights,
by a table of as many gains as there are buckets. The draw sorts by ranges of scores and
numbers within them: no task holds all scores.

Defined results: a null or empty text has no words and weight 0; very long texts are hashed
whole, in chunks that overlap by two words; repeated rows are texts by themselves, equal in all but rank; of
equal scores the smaller id comes first, no id last, and equal rows in the order of the stored
table; a row without an id draws as the id ``null``; an empty corpus gives no rows, an
empty target weighs all buckets as if it had none; columns that aren't named are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, holding, pieces, require, worker_cache

BUCKETS = 10_000
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Words of a chunk, about; its ids have 20 bits or fewer.
CHUNK_WORDS = 400_000
_BITS = 20

_SHIFTS: dict[int, np.ndarray] = worker_cache({})


def _shift(size: int) -> np.ndarray:
    """What ``size`` bytes after it do to a checksum, for each value of each of its four bytes; sums are by xor."""
    if size not in _SHIFTS:
        zeros = bytes(size)
        none = zlib.crc32(zeros, 0)
        _SHIFTS[size] = np.array([[zlib.crc32(zeros, byte << 8 * k) ^ none for byte in range(256)] for k in range(4)], np.uint32)
    return _SHIFTS[size]


def _extended(sums: np.ndarray, more: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Checksums of texts with further bytes, from those of both and the further ones' lengths."""
    out = more.copy()
    if not len(sizes):
        return out
    order = np.argsort(sizes, kind="stable")
    ends = np.flatnonzero(np.diff(sizes[order], append=-1)) + 1
    for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
        at = order[lo:hi]
        table, x = _shift(int(sizes[at[0]])), sums[at]
        out[at] ^= table[0][x & 255] ^ table[1][x >> 8 & 255] ^ table[2][x >> 16 & 255] ^ table[3][x >> 24]
    return out


class Chunk:
    """Words of some texts, numbered, with a mark after each text."""

    def __init__(self):
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.ids: list[int] = []

    def add(self, words: list[bytes]) -> None:
        self.ids += map(self.number.__getitem__, words)
        self.ids.append(-1)

    def full(self) -> bool:
        return len(self.ids) >= CHUNK_WORDS or len(self.number) >= 1 << _BITS - 1

    def suffixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in the order of their suffixes; the first three words there (-1 after a text's end); LCP with the one before."""
        ids = np.array([*self.ids, -1, -1], np.int64)
        words = np.stack([ids[:-2], ids[1:-1], ids[2:]])
        words[2][words[1] < 0] = -1
        places = np.flatnonzero(words[0] >= 0)
        words = words[:, places]
        if len(self.number) < 1 << _BITS:
            order = np.argsort((words[0] << 2 * _BITS + 2) + (words[1] + 1 << _BITS + 1) + words[2] + 1, kind="stable")
        else:
            order = np.lexsort(words[::-1])
        words = words[:, order]
        same = np.zeros(words.shape, bool)
        same[:, 1:] = words[:, 1:] == words[:, :-1]
        return places[order], words, np.cumprod(same, axis=0).sum(axis=0)

    def buckets(self, buckets: int) -> list[np.ndarray]:
        """For n = 1, 2, 3, the bucket of the n words from each place on; only places with as many words are filled."""
        places, words, lcp = self.suffixes()
        out = [np.zeros(len(self.ids), np.uint32) for _ in range(3)]
        if not len(places):
            return out
        texts = list(self.number)
        plain = np.array([zlib.crc32(w) for w in texts], np.uint32)
        spaced = np.array([zlib.crc32(b" " + w) for w in texts], np.uint32)
        size = np.array([len(w) + 1 for w in texts], np.int64)
        for n in range(3):
            starts = np.flatnonzero(lcp <= n)  # a run of n + 1 words begins
            if n == 0:
                sums = plain[words[0][starts]]
            else:
                # The run's n first words are those of the shorter run that it lies in.
                sums = sums[np.cumsum(lcp < n)[starts] - 1]
                long = words[n][starts] >= 0
                last = words[n][starts[long]]
                sums[long] = _extended(sums[long], spaced[last], size[last])
            out[n][places] = (sums % np.uint32(buckets))[np.cumsum(lcp <= n) - 1]
        return out


def _hashed(words: list[list[bytes]], buckets: int) -> Iterator[list[bytes]]:
    """Buckets of each text as unsigned 16-bit integers (32-bit ones beyond 65,536 buckets)."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    chunk, parts, rest = Chunk(), [], []

    def closed() -> list[bytes]:
        """Texts that end in the chunk; ``rest`` has what it holds of one that goes on."""
        nonlocal rest
        found, at, out = chunk.buckets(buckets), 0, []
        for own, n, ends in parts:
            rest += [found[k][at : at + max(0, min(own, n - k))] for k in range(3)]
            at += n + 1
            if ends:
                out.append(np.concatenate(rest).astype(kind).tobytes())
                rest = []
        return out

    for own in words:
        # Parts of a long text overlap by the two words that runs from the last places need.
        for lo in range(0, len(own) or 1, CHUNK_WORDS):
            part = own[lo : lo + CHUNK_WORDS + 2]
            chunk.add(part)
            parts.append((CHUNK_WORDS, len(part), lo + CHUNK_WORDS >= len(own)))
            if chunk.full():
                yield closed()
                chunk, parts = Chunk(), []
    if parts:
        yield closed()


def features(texts: DataFrame, *, text_col: str = "text", id_col: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Per text: id, place (a number of its row), n_words, n_features, buckets (binary)."""
    require(texts, text_col, *([id_col] if id_col else []))
    named = F.col(id_col) if id_col else F.lit(None).cast("bigint")
    rows = texts.select(named.alias("id"), F.monotonically_increasing_id().alias("place"), F.col(text_col).alias("text"))
    names = ["id", "place", "n_words", "n_features", "buckets"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding(_SHIFTS)
        for batch in batches:
            for part in pieces(batch, 2, rows=20_000, size=4 << 20):
                words = [WORD.findall((t or b"").translate(_LOWER)) for t in part.column(2).cast(pa.binary()).to_pylist()]
                found = pa.array([b for some in _hashed(words, buckets) for b in some], pa.binary())
                n = np.array([len(w) for w in words], np.int64)
                count = n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(count), found], names=names)

    of = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(task, f"id {of}, place bigint, n_words bigint, n_features bigint, buckets binary")


def _numbers(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column one after another, and where each row's begin (one more than rows)."""
    size = 2 if buckets <= 1 << 16 else 4
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, f"<u{size}"), np.cumsum([0, *(len(x) // size for x in column.to_pylist())])


def bucket_counts(hashed: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket; a task sends one row for each of its buckets."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding(None)
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_numbers(batch.column(0), buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counted = hashed.select("buckets").mapInArrow(task, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():  # as many rows as there are buckets, at most
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the corpus)) of each bucket, with one feature more in each."""
    all_corpus, all_target = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_corpus / ((s + 1.0) * all_target))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(hashed: DataFrame, gain: np.ndarray) -> DataFrame:
    """``hashed`` with weight, the sum of its features' gains, in place of the buckets."""
    of = hashed.schema["id"].dataType.simpleString()
    names = ["id", "place", "n_words", "n_features", "weight"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding(None)
        for batch in batches:
            numbers, starts = _numbers(batch.column(4), len(gain))
            sums = np.concatenate([[0], np.cumsum(gain[numbers])])[starts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.diff(sums))], names=names)

    return hashed.select("id", "place", "n_words", "n_features", "buckets").mapInArrow(task, f"id {of}, place bigint, n_words bigint, n_features bigint, weight bigint")


def _gumbel(id_: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256(``seed``:id)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _ranked(scored: DataFrame, most: int) -> DataFrame:
    """(place, rank) of the ``most`` highest scores."""
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("place")]
    rows = scored.select("id", "place", "score").repartitionByRange(*order)
    rows = cut(rows.withColumn("part", F.spark_partition_id()))
    sizes = rows.groupBy("part").agg(F.count("*").alias("size"))  # one row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).where(F.col("before") < most)
    within = Window.partitionBy("part").orderBy(*order)
    ranked = rows.join(F.broadcast(sizes.select("part", "before")), "part").withColumn("rank", F.col("before") + F.row_number().over(within))
    return ranked.where(F.col("rank") <= most).select("place", F.col("rank").cast("bigint").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", percent: int = 5, least_words: int = 20, buckets: int = BUCKETS, seed: str = "42") -> DataFrame:
    """Per document: doc_id, n_words, n_features, weight, score, rank (null unless drawn).

    Of the documents with ``least_words`` words or more, ``percent`` in a hundred are drawn.
    """
    require(target, target_text_col)
    hashed = cut(features(docs, id_col=id_col, text_col=text_col, buckets=buckets))
    gain = gains(bucket_counts(hashed, buckets), bucket_counts(features(target, text_col=target_text_col, buckets=buckets), buckets))
    scored = cut(weights(hashed, gain).withColumn("score", F.col("weight") + _gumbel(F.col("id"), seed)))
    eligible = scored.where(F.col("n_words") >= least_words)
    drawn = _ranked(eligible, eligible.count() * percent // 100)
    out = scored.join(drawn, "place", "left")
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_features", "weight", "score", "rank")
