"""Phrase collocations by hierarchical pair naming.

A word, and then each frequent run of k words, has a name: a number joined globally. The
name of a run of k words is that of a pair, the names of its first and its last k - 1
words. A pair therefore points to its parents, and what the mining asks about a phrase is
a walk along such pointers: the first and the rest of a cut are parents of parents, and a
phrase lies inside a longer one if it is a parent of it.

Texts are read once. Tasks pack them into blocks of one language: the block's own words,
numbered as they come, and the run of these numbers, in which a mark stands where a piece
ends. A level then has two shuffles: what blocks count is summed to names, and names meet
blocks again by block and place in the block. A block gets names for the frequent runs it
holds (a list that the block bounds), replaces each run by the name, and counts pairs of
neighbours, which are runs of one word more. A word as common as can be is one row for a
block, so no key is hot. Rows of pairs that are too rare to have a name are left out before
they are shuffled again by a bit map of a fixed size over the names; it passes some too many,
which the join then drops.

Scores are quotients of whole numbers with 38 digits. A language's list is cut twice, by
salted parts first, so that no task ranks all phrases of a language.

Defined results: a null or empty text has no words; very long texts and pieces are read whole (a
piece lies in one block); a null language is ``und``; repeated rows count as often as they
occur; ties are broken by the phrase, which is unique in its language; an empty table
gives no phrases; only the language's and the text's columns are read, so others may
have any name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BATCH, discard, fresh_dir, holding, pieces, require

#: A-Z become a-z, a tab a blank, and marks that end a piece a line end.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
#: Places and words of a block, and places that a task holds in all its open blocks.
BLOCK_PLACES, BLOCK_WORDS, OPEN_PLACES = 600_000, 200_000, 3_000_000
#: Bits of the map that leaves rare pairs out: 2 MB, whatever the input.
_BITS = 1 << 24
#: Files of blocks have row groups of few rows: a reader decodes one group at once.
_GROUPS = {"compression": "zstd", "parquet.block.size": str(8 << 20), "parquet.block.row.count.limit": "2"}
#: While a table is written: blocks go to Python few at a time, and its shuffles' files go once it is there.
_WRITING = (BATCH, ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"))
#: Parts of a language that are ranked by themselves first.
_SALTS = 64

_BLOCKS = "block bigint, lang string, places int, run binary, words array<string>, counts array<bigint>"
_PAIRS = "block bigint, lang string, places int, run binary, firsts array<bigint>, lasts array<bigint>, counts array<bigint>"


def _stored(df: DataFrame, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder, without its lineage."""
    spark, path = df.sparkSession, fresh_dir(df.sparkSession, "phrases")
    before = {name: spark.conf.get(name) for name, _ in _WRITING}
    for setting in _WRITING:
        spark.conf.set(*setting)
    try:
        df.write.options(**options).parquet(path)
    finally:
        for setting in before.items():
            spark.conf.set(*setting)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["cut_path"] = path
    return out


def _packed(numbers: np.ndarray, kind: str = "<i4") -> bytes:
    """The numbers' first bytes, then their second ones and so on, compressed."""
    planes = numbers.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T
    return pa.Codec("zstd").compress(np.ascontiguousarray(planes).tobytes(), asbytes=True)


def _unpacked(data: bytes, size: int, kind: str = "<i4") -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, width * size), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


class _Open:
    """A block that a task still fills."""

    def __init__(self, most: int):
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.run: list[int] = []
        self.most = most

    def add(self, piece: list[bytes]) -> None:
        self.run += map(self.number.__getitem__, piece)
        self.run.append(-1)

    def full(self) -> bool:
        return len(self.run) >= self.most or len(self.number) >= BLOCK_WORDS


def _blocks(docs: DataFrame, text_col: str, lang_col: str, block_places: int) -> DataFrame:
    """Blocks of words: their number, language, run, words and how often each occurs."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding(None)
        block = TaskContext.get().partitionId() << 33
        opened: dict[str, _Open] = {}
        held = 0

        def closed(lang: str) -> pa.RecordBatch:
            nonlocal block, held
            done, block = opened.pop(lang), block + 1
            held -= len(done.run)
            run = np.array(done.run, np.int32)
            counts = np.bincount(run[run >= 0], minlength=len(done.number))
            columns = [
                pa.array([block - 1], pa.int64()),
                pa.array([lang]),
                pa.array([len(run)], pa.int32()),
                pa.array([_packed(run)], pa.binary()),
                pa.array([[w.decode("utf-8", "replace") for w in done.number]], pa.list_(pa.string())),
                pa.array([counts], pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["block", "lang", "places", "run", "words", "counts"])

        for batch in batches:
            for part in pieces(batch, 1):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    for piece in (text or b"").translate(_PLAIN).split(b"\n"):
                        if words := piece.split():
                            into = opened.get(lang) or opened.setdefault(lang, _Open(block_places))
                            into.add(words)
                            held += len(words) + 1
                            if into.full():
                                yield closed(lang)
                    if held > OPEN_PLACES:
                        for other in list(opened):
                            yield closed(other)
        for other in list(opened):
            yield closed(other)

    return rows.mapInArrow(task, _BLOCKS)


def _paired(blocks: DataFrame) -> DataFrame:
    """Blocks (of ``_with_names``) with runs replaced by names, and pairs of neighbours as the new runs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding(None)
        for batch in batches:
            for i in range(batch.num_rows):
                block, lang, places, run, size, place, name = (batch.column(k)[i] for k in range(7))
                run = _unpacked(run.as_py(), places.as_py())
                place, name = np.cumsum(_unpacked(place.as_py(), size.as_py())), _unpacked(name.as_py(), size.as_py(), "<i8")
                most = max(int(run.max()), int(place.max())) + 1
                names = np.full(most + 1, -1, np.int64)  # the last is for marks
                names[place] = name
                named = names[run] >= 0
                at = np.flatnonzero(named[:-1] & named[1:])
                pairs, which, counts = np.unique(run[at].astype(np.int64) * (most + 1) + run[at + 1], return_inverse=True, return_counts=True)
                if not len(pairs):
                    continue
                new = np.full(len(run), -1, np.int32)
                new[at] = which
                columns = [
                    pa.array([block.as_py()], pa.int64()),
                    pa.array([lang.as_py()]),
                    pa.array([len(new)], pa.int32()),
                    pa.array([_packed(new)], pa.binary()),
                    pa.array([names[pairs // (most + 1)]], pa.list_(pa.int64())),
                    pa.array([names[pairs % (most + 1)]], pa.list_(pa.int64())),
                    pa.array([counts], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "lang", "places", "run", "firsts", "lasts", "counts"])

    return blocks.select("block", "lang", "places", "run", "size", "place", "name").mapInArrow(task, _PAIRS)


def _bit(first, last):
    """A pair's bit; the same whole numbers for columns and arrays."""
    return (first % 2147483647 * 1000003 + last % 2147483647) % _BITS


def _bits(names: DataFrame) -> np.ndarray:
    """The map of the pairs that have names."""
    bit = _bit(F.col("first"), F.col("last"))
    # Spark's maps have numbers from 1 on and hold values from 1 on.
    maps = names.groupBy(F.bitmap_bucket_number(bit + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit + 1)).alias("bits")).collect()
    bits = np.zeros(_BITS // 8, np.uint8)
    for r in maps:  # 512 maps of 4 kB at most
        bits[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    return bits


def _known_pairs(blocks: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the pairs that may have a name (all that have, few others) and stand beside another: blocks with runs of
    them alone, and (block, place in its list, first, last) of each."""
    mapped = blocks.sparkSession.sparkContext.broadcast(_bits(names))

    def thinned(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        run = _unpacked(batch.column(3)[i].as_py(), batch.column(2)[i].as_py())
        first, last = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (4, 5))
        bit = _bit(first, last)
        named = np.append((mapped.value[bit >> 3] >> (bit & 7) & 1).astype(bool), False)[run]
        beside = np.zeros(len(run), bool)  # a pair alone is in no longer run
        beside[1:] |= named[:-1]
        beside[:-1] |= named[1:]
        return np.where(named & beside, run, -1), first, last

    def each(of_block):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            holding(None)
            for batch in batches:
                for i in range(batch.num_rows):
                    yield of_block(batch.slice(i, 1), *thinned(batch, i))

        return task

    def runs(row: pa.RecordBatch, run: np.ndarray, *_: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*row.columns[:3], pa.array([_packed(run)], pa.binary())], names=["block", "lang", "places", "run"])

    def pairs(row: pa.RecordBatch, run: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
        at = np.unique(run[run >= 0]).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row.column(0)[0].as_py())), pa.array(at), pa.array(first[at]), pa.array(last[at])], names=["block", "place", "first", "last"])

    rows = blocks.select("block", "lang", "places", "run", "firsts", "lasts")
    return rows.mapInArrow(each(runs), "block bigint, lang string, places int, run binary"), rows.mapInArrow(each(pairs), "block bigint, place bigint, first bigint, last bigint")


def _with_names(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """Blocks with the names (block, place, id) of what they list, packed: size, steps from place to place, names.

    The lists are stored first, so that their shuffles and those of the blocks don't take room together.
    """
    lists = known.groupBy("block").agg(F.collect_list(F.struct("place", "id")).alias("known"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding(None)
        for batch in batches:
            for i in range(batch.num_rows):
                place, name = (batch.column(1)[i].values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                order = np.argsort(place, kind="stable")
                columns = [batch.column(0).slice(i, 1), pa.array([len(order)], pa.int32()), pa.array([_packed(np.diff(place[order], prepend=0))], pa.binary()), pa.array([_packed(name[order], "<i8")], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "size", "place", "name"])

    lists = _stored(lists.mapInArrow(task, "block bigint, size int, place binary, name binary"), **_GROUPS)
    return blocks.select("block", "lang", "places", "run").join(lists, "block")


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows``, stored, with ``id``, numbers from 0 on without gaps: small numbers shuffle in few bytes."""
    rows = _stored(rows.withColumn("raw", F.monotonically_increasing_id()))
    parts = rows.groupBy(F.shiftright("raw", 33).alias("part")).agg(F.count("*").alias("size"))  # one row for each task that wrote
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = rows.withColumn("part", F.shiftright("raw", 33)).join(F.broadcast(parts), "part")
    return numbered.withColumn("id", F.col("before") + F.col("raw").bitwiseAND((1 << 33) - 1)).drop("raw", "part", "before")


def _words(blocks: DataFrame, least: int) -> DataFrame:
    """Names of frequent words."""
    listed = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    counted = listed.groupBy("lang", F.col("w.words").alias("phrase")).agg(F.sum("w.counts").alias("f")).where(F.col("f") >= least)
    none = F.array().cast("array<bigint>")
    return _stored(_numbered(counted).select("id", "lang", "phrase", F.col("phrase").alias("last_word"), "f", none.alias("starts"), none.alias("ends")))


def _pairs(blocks: DataFrame, names: DataFrame, least: int) -> DataFrame:
    """Names of frequent pairs of ``names``, with their phrase and the counts of its starts and ends by length."""
    listed = blocks.select(F.explode(F.arrays_zip("firsts", "lasts", "counts")).alias("p"))
    counted = listed.groupBy(F.col("p.firsts").alias("first"), F.col("p.lasts").alias("last")).agg(F.sum("p.counts").alias("f")).where(F.col("f") >= least)
    first = names.select(F.col("id").alias("first"), "lang", F.col("phrase").alias("first_phrase"), F.concat("starts", F.array("f")).alias("starts"))
    last = names.select(F.col("id").alias("last"), "last_word", F.concat("ends", F.array("f")).alias("ends"))
    out = _numbered(counted).join(first, "first").join(last, "last")
    return _stored(out.select("id", "lang", F.concat_ws(" ", "first_phrase", "last_word").alias("phrase"), "last_word", "f", "starts", "ends", "first", "last"))


def score(a: Column, first: Column, rest: Column) -> Column:
    """floor(1000000 a a / (first rest)), exact."""
    wide = lambda c: c.cast("decimal(38,0)")
    over, under = wide(wide(wide(a) * wide(a)) * F.lit(1000000)), wide(wide(first) * wide(rest))
    # The remainder goes first, so that the quotient is whole.
    return ((over - over % under) / under).cast("bigint")


def _cut(names: DataFrame, length: int) -> DataFrame:
    """Candidates of a length with their lowest-scoring cut (the first of equal ones)."""
    cuts = [F.struct(score(F.col("f"), F.col("starts")[j - 1], F.col("ends")[length - j - 1]).alias("score"), F.lit(j).alias("k"), F.col("starts")[j - 1].alias("l"), F.col("ends")[length - j - 1].alias("r")) for j in range(1, length)]
    return names.withColumn("cut", F.array_min(F.array(*cuts))).select("id", "lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")


def _not_inside(candidates: DataFrame, longer: DataFrame, percent: int) -> DataFrame:
    """Candidates that aren't parents of a name that occurs ``percent`` times in a hundred of theirs.

    Parents alone are asked: between a phrase and a longer one that holds it lies, word by
    word, a chain of phrases that occur at least as often as the longer one.
    """
    most = longer.select(F.explode(F.array("first", "last")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("inside"))
    kept = candidates.join(most, "id", "left")
    return kept.where(F.col("inside").isNull() | (100 * F.col("inside") < percent * F.col("a"))).drop("inside")


def mine(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 10, most_words: int = 3, inside_percent: int = 50, block_places: int = BLOCK_PLACES) -> tuple[DataFrame, DataFrame]:
    """Phrases of 2 to ``most_words`` words (lang, phrase, a, l, r, score), and (lang, n) of all words.

    Phrases that occur fewer than ``least`` times are none; those inside a longer one that
    occurs ``inside_percent`` of a hundred times as often are dropped.
    """
    require(docs, text_col, lang_col)
    if most_words < 2:
        raise ValueError("most_words must be 2 or more")
    blocks = _stored(_blocks(docs, text_col, lang_col, block_places), **_GROUPS)
    totals = blocks.select("lang", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    totals = _stored(totals)
    names = _words(blocks, least)
    listed = blocks.select("block", "lang", F.posexplode("words").alias("place", "phrase"))
    known = listed.join(names.select("lang", "phrase", "id"), ["lang", "phrase"]).select("block", F.col("place").cast("bigint").alias("place"), "id")
    candidates, found, runs = None, None, blocks
    for length in range(2, most_words + 1):
        before, blocks = blocks, _stored(_paired(_with_names(runs, known)), **_GROUPS)
        discard(before)
        names = _pairs(blocks, names, least)
        if candidates is not None:
            kept = _not_inside(candidates, names, inside_percent)
            found = kept if found is None else found.unionByName(kept)
        candidates = _cut(names, length)
        if length < most_words:
            runs, pairs = _known_pairs(blocks, names)
            known = pairs.join(names.select("first", "last", "id"), ["first", "last"]).select("block", "place", "id")
    discard(blocks)
    found = candidates if found is None else found.unionByName(candidates)
    return found.drop("id"), totals


def top(phrases: DataFrame, totals: DataFrame, *, most: int = 2000) -> DataFrame:
    """The first ``most`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = phrases.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
