"""Token ids as flat binary files, memory-mapped on reading.

Format, one set of files for each partition of ascending document ids:

* ``N-<attempt>.bin``: token ids, little-endian unsigned 16-bit (32-bit where
  the vocabulary needs it), nothing between documents;
* ``N-<attempt>.idx``: n + 1 little-endian signed 64-bit offsets into the
  ``.bin``, in ids, then n document ids (64-bit), then n bytes: 0 where the
  document id is null.

``manifest.json`` lists the files in order with their counts and *bases*, the
prefix sums of the counts: document and token k of a partition are document and
token base + k of the whole. Partitions are written independently; attempts
write under names of their own, and the manifest names those that succeeded, so
retried and speculative tasks do no harm.

Plan: one range shuffle by document id (ties by text), then encode and write in
the same task, batch by batch; the driver sees one row for each file.

Defined results: a null text is empty; a very long one is encoded whole; a null document
id sorts first, ids that are no numbers are refused; documents of one id are ordered by a
hash of the text; repeated rows are kept, each with its own slot; other columns are not
read, so they may be named as those made here; an empty table gives an empty manifest.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Numbered, holding, pieces, require, small_batches, worker_cache

#: White_Space of Unicode (fixed values). A token of a byte-level BPE never
#: runs over a border from another character to one of these.
SPACES = "\x09-\x0d\x20\x85\xa0  -     　"
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Latin letters up to white space or plain punctuation are one pre-token with the
#: blank before them; anything else is taken up to the next white space.
CHUNKS = re.compile(f" ?[{LETTERS}]+(?=[{SPACES}.,;:!?|)]|\\Z)|[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
PLAIN = re.compile(f" [{LETTERS}]+")
#: Some 230 bytes each, in every Python worker of an executor.
MOST_CHUNKS, MOST_CHARS = 300_000, 6_000_000


class Encoder:
    """``tokenizers`` ids of whole texts; repeated chunks are encoded once.

    It holds ``MOST_CHUNKS`` chunks or ``MOST_CHARS`` characters of them and a few texts' more;
    beyond that only those met again since the last time stay.

    The cuts between chunks are exact for byte-level pre-tokenisers without a
    normaliser. Texts that hold an added token's string, and all texts of other
    kinds of tokenizer, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        self.chunks = Numbered(MOST_CHUNKS, MOST_CHARS)
        self._empty()

    def _empty(self) -> None:
        self.chunks.trim()
        self.flat, self.starts, self.sizes, self.again = np.zeros(1 << 16, "<u4"), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, bool)
        self.used = self.known = 0

    def _at(self, k: np.ndarray) -> np.ndarray:
        """Where the ids of these chunks are."""
        sizes = self.sizes[k]
        ends = np.cumsum(sizes)
        return np.repeat(self.starts[k] - (ends - sizes), sizes) + np.arange(ends[-1] if len(k) else 0)

    def _shrink(self) -> None:
        """Most chunks never come again: those that did stay, unless they fill more than half."""
        k = np.flatnonzero(self.again[: self.known])
        self.chunks.trim(k.tolist())
        if len(k) > self.chunks.most // 2 or self.chunks.chars > self.chunks.most_chars // 2:
            self._empty()
            return
        ids, sizes = self.flat[self._at(k)], self.sizes[k]
        self.used, self.known = len(ids), len(k)
        self.flat[: self.used], self.sizes[: self.known] = ids, sizes
        self.starts[: self.known] = np.cumsum(sizes) - sizes
        self.again[:] = False

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _settle(self, new: list[str]) -> None:
        """Ids of new chunks. Single pre-tokens go to the library in long strings."""
        single = list(map(PLAIN.fullmatch, new))
        plain, rest = ([k for k, m in enumerate(single) if (m is not None) == x] for x in (True, False))
        ids, counts = [], []
        for lo in range(0, len(plain), 1000):
            found = self.library.encode("".join([new[k] for k in plain[lo : lo + 1000]]), add_special_tokens=False)
            ids.append(np.array(found.ids, "<u4"))
            counts.append(np.bincount(np.array(found.word_ids, np.int64)))
        for lo in range(0, len(rest), 2000):  # the library makes large objects
            own = self._library([new[k] for k in rest[lo : lo + 2000]])
            counts.append(np.fromiter(map(len, own), np.int64, len(own)))
            ids.append(np.fromiter(chain.from_iterable(own), "<u4", int(counts[-1].sum())))
        order, sizes = np.array(plain + rest), np.concatenate(counts)
        if len(order) != len(sizes):
            raise ValueError("the tokenizer splits single words")
        total = int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        while self.known + len(new) > len(self.starts):
            self.starts, self.sizes, self.again = (np.r_[x, np.zeros_like(x)] for x in (self.starts, self.sizes, self.again))
        self.flat[self.used : self.used + total] = np.concatenate(ids)
        self.starts[self.known + order] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.known + order] = sizes
        self.used += total
        self.known += len(new)

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        for lo in range(0, len(texts), 64):
            yield from self._some(texts[lo : lo + 64])

    def _some(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        whole = [not self.cuts or any(a in t for a in self.added) if t else False for t in texts]
        cut = [self.chunks.numbers(CHUNKS.findall(t)) if t and not w else [] for t, w in zip(texts, whole, strict=True)]
        known = self.known
        self.chunks.settle(self._settle)
        for text, numbers, w in zip(texts, cut, whole, strict=True):
            if w:
                yield np.array(self._library([text])[0], "<u4")
                continue
            k = np.array(numbers, np.int64)
            self.again[k[k < known]] = True
            yield self.flat[self._at(k)]
        if self.chunks.full():
            self._shrink()


_ENCODERS: dict[str, Encoder] = worker_cache({})


def encoder(path: str) -> Encoder:
    holding(_ENCODERS)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root)


def write(
    docs: DataFrame,
    root: str,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    partitions: int | None = None,
) -> dict:
    """Write the token files of ``docs`` under ``root`` and return the manifest.

    ``tokenizer`` is a path that every executor has; ``partitions`` defaults to
    the session's number of shuffle partitions.
    """
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    filesystem, base = _open(root)
    filesystem.create_dir(base, recursive=True)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        enc = encoder(tokenizer)
        width = "<u2" if max(enc.vocabulary, end_id + 1) <= 1 << 16 else "<u4"
        target, folder = _open(root)
        name = f"{part:06d}-{run}"
        lengths, ids, valid, out = [], [], [], None
        for batch in batches:
            if batch.num_rows and out is None:
                out = target.open_output_stream(f"{folder}/{name}.bin")
            ids += batch.column(0).fill_null(0).to_pylist()
            valid += batch.column(0).is_valid().to_pylist()
            for some in pieces(batch, 1):
                for found in enc.encode(some.column(1).to_pylist()):
                    out.write(np.append(found, np.uint32(end_id)).astype(width).tobytes())
                    lengths.append(len(found) + 1)
        if out is None:
            return
        out.close()
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
        with target.open_output_stream(f"{folder}/{name}.idx") as f:
            f.write(offsets.tobytes() + np.array(ids, "<i8").tobytes() + np.array(valid, "u1").tobytes())
        yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "width": width, "n_docs": len(lengths), "n_tokens": int(offsets[-1])}], schema=FOUND)

    FOUND = pa.schema([("part", pa.int64()), ("name", pa.string()), ("width", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    tie = [F.xxhash64("text"), F.monotonically_increasing_id()]
    rows = rows.select("id", "text", tie[0].alias("h"), tie[1].alias("m")).repartitionByRange(count, "id", "h", "m").sortWithinPartitions("id", "h", "m").select("id", "text")
    with small_batches(spark):
        found = rows.mapInArrow(task, "part bigint, name string, width string, n_docs bigint, n_tokens bigint").collect()
    files, doc_base, token_base = [], 0, 0
    for r in sorted(found, key=lambda r: r.part):
        files.append({"name": r.name, "width": r.width, "n_docs": r.n_docs, "n_tokens": r.n_tokens, "doc_base": doc_base, "token_base": token_base})
        doc_base += r.n_docs
        token_base += r.n_tokens
    manifest = {"files": files, "n_docs": doc_base, "n_tokens": token_base, "end_id": end_id}
    with filesystem.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def _mapped(root: str, name: str, dtype: str) -> np.ndarray:
    """A file's content: memory-mapped where the file system allows, else read."""
    filesystem, base = _open(root)
    if isinstance(filesystem, pafs.LocalFileSystem):
        return np.memmap(f"{base}/{name}", dtype=dtype, mode="r")
    with filesystem.open_input_file(f"{base}/{name}") as f:
        return np.frombuffer(f.read_buffer(), dtype)


def read(spark: SparkSession, root: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, ids.

    ``start`` counts the ids of all documents before it; ``ids`` is an array.
    """
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids array<bigint>"
    return _each(spark, root, schema, True)


def digests(spark: SparkSession, root: str) -> DataFrame:
    """As ``read``, without the ids themselves."""
    return _each(spark, root, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint", False)


def _each(spark: SparkSession, root: str, schema: str, with_ids: bool) -> DataFrame:
    filesystem, base = _open(root)
    with filesystem.open_input_stream(f"{base}/manifest.json") as f:
        files = json.loads(f.read())["files"]
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    kind = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * with_ids)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding(None)
        for batch in batches:
            for f in batch.to_pylist():
                n = f["n_docs"]
                raw = _mapped(root, f"{f['name']}.idx", "u1")
                offsets, ids, valid = raw[: 8 * n + 8].view("<i8"), raw[8 * n + 8 : 16 * n + 8].view("<i8"), raw[16 * n + 8 :]
                tokens = _mapped(root, f"{f['name']}.bin", f["width"])
                for lo in range(0, n, 1024):
                    rows = []
                    for k in range(lo, min(n, lo + 1024)):
                        a, b = int(offsets[k]), int(offsets[k + 1])
                        own = tokens[a:b].astype("<u4")
                        row = {"doc_id": int(ids[k]) if valid[k] else None, "start": f["token_base"] + a, "n_tokens": b - a, "ids_crc32": zlib.crc32(own.tobytes())}
                        rows.append(row | {"ids": own.astype("i8")} if with_ids else row)
                    yield pa.RecordBatch.from_pylist(rows, schema=kind)

    listed = spark.createDataFrame([tuple(f[k] for k in ("name", "width", "n_docs", "token_base")) for f in files], "name string, width string, n_docs bigint, token_base bigint")
    return listed.repartition(max(1, len(files))).mapInArrow(task, schema)
