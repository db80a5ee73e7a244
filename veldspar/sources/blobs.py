"""Rasters by byte range: a data source that seeks, and a writer of packed blobs.

A session's rasters stand one after another in a blob; an index line gives each its offset and length.
A session has either one blob and index (``depth.bin``, ``depth.jsonl``) or, as the writer here makes
them, parts of both in a folder (``depth/<offset of the part>.bin`` and ``.jsonl``), whose offsets go on
from part to part. Offsets are 64-bit throughout.

The reader's partitions are byte ranges of index files; a task reads the lines that begin in its
range, leaves out what the pushed filters on session and frame exclude, and reads the bytes of each
raster that is left. No blob is read whole and no index is read on the driver. Files are opened with ``pyarrow.fs``
(local and mounted folders, S3, GCS, HDFS).

The writer's tasks write parts into a folder of the job's own; the commit moves them to their
sessions, index parts last, and an abort removes the folder. What a lost or repeated task has left behind goes with it.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "session_id string, frame bigint, t double, width int, height int, values array<float>"
_ARROW = pa.schema([("session_id", pa.string()), ("frame", pa.int64()), ("t", pa.float64()), ("width", pa.int32()), ("height", pa.int32()), ("values", pa.list_(pa.float32()))])
#: Index keys of a raster's place, and numpy's kind of its numbers, by kind.
KINDS = {"depth": ("offset", "length", "<f2"), "confidence": ("confidenceOffset", "confidenceLength", "u1")}
#: Bytes of an index that a task reads by default; some 600 lines, or 60 MB of rasters of 256 x 192.
INDEX_BYTES = 128 << 10


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.rstrip("/"))


class Blobs:
    """A session's blob of a kind, or its parts, by offset."""

    def __init__(self, store: fs.FileSystem, session: str, kind: str):
        self.store, self.kind, self.now, self.file = store, kind, None, None
        self.parts = {0: f"{session}/{kind}.bin"}
        if store.get_file_info(self.parts[0]).type != fs.FileType.File:
            found = store.get_file_info(fs.FileSelector(f"{session}/{kind}", allow_not_found=True))
            self.parts = {int(f.base_name[: -len(".bin")]): f.path for f in found if f.base_name.endswith(".bin")} or self.parts
        self.starts = sorted(self.parts)

    def raster(self, offset: int, length: int, width: int, height: int) -> np.ndarray:
        """Numbers of one raster, by rows; fails if the blob ends before it does or it holds too few."""
        start = self.starts[max(0, bisect_right(self.starts, offset) - 1)]
        if start != self.now:
            self.now, self.file = start, self.store.open_input_file(self.parts[start])
        self.file.seek(offset - start)
        raw = self.file.read(length)
        numbers, count = KINDS[self.kind][2], width * height
        if len(raw) < length or len(raw) < count * np.dtype(numbers).itemsize:
            raise ValueError(f"a raster is cut short: {len(raw)} bytes at {offset}")
        return np.frombuffer(raw, numbers, count).astype("f4")


@dataclass
class Wanted:
    """What pushed filters leave: sessions (None for all) and the least and greatest frame."""

    sessions: set[str] | None = None
    least: float = float("-inf")
    most: float = float("inf")

    def take(self, f: Filter) -> bool:
        """Whether the filter is applied here."""
        if isinstance(f, (EqualTo, In)):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            if f.attribute == ("session_id",):
                self.sessions = values if self.sessions is None else self.sessions & values
                return True
            if f.attribute == ("frame",) and isinstance(f, EqualTo):
                self.least, self.most = max(self.least, f.value), min(self.most, f.value)
                return True
        elif getattr(f, "attribute", None) == ("frame",):
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.least = max(self.least, f.value + isinstance(f, GreaterThan))
                return True
            if isinstance(f, (LessThan, LessThanOrEqual)):
                self.most = min(self.most, f.value - isinstance(f, LessThan))
                return True
        return False


@dataclass
class IndexRange(InputPartition):
    """Lines of a session's index file that begin from ``start`` to before ``end``."""

    session: str
    index: str
    start: int
    end: int


class RasterSource(DataSource):
    """Rasters under a folder of sessions. Options: path, kind (depth or confidence), indexBytes."""

    @classmethod
    def name(cls) -> str:
        return "session_rasters"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RasterReader:
        return RasterReader(self.options)


class RasterReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.kind, self.size = options["path"], options.get("kind", "depth"), int(options.get("indexbytes", options.get("indexBytes", INDEX_BYTES)))
        self.wanted = Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return [f for f in filters if not self.wanted.take(f)]

    def partitions(self) -> list[IndexRange]:
        store, root = open_fs(self.root)
        out = []
        for found in store.get_file_info(fs.FileSelector(root)):
            session = found.base_name
            if found.type != fs.FileType.Directory or session.startswith(".") or self.wanted.sessions is not None and session not in self.wanted.sessions:
                continue
            indexes = [f"{found.path}/depth.jsonl"]
            indexes += [f.path for f in store.get_file_info(fs.FileSelector(f"{found.path}/depth", allow_not_found=True)) if f.base_name.endswith(".jsonl")]
            for f in store.get_file_info(indexes):
                if f.type == fs.FileType.File:
                    out += [IndexRange(session, f.path, a, min(f.size, a + self.size)) for a in range(0, f.size, self.size)]
        return out

    def read(self, part: IndexRange) -> Iterator[pa.RecordBatch]:
        store, _ = open_fs(self.root)
        at, size, _ = KINDS[self.kind]
        blobs, rows, held = None, [], 0
        for line in lines_from(store, part.index, part.start, part.end):
            try:
                x = json.loads(line)
            except ValueError:  # a torn line
                continue
            if not isinstance(x, dict) or x.get(at) is None or x.get("frame") is None or not self.wanted.least <= x["frame"] <= self.wanted.most:
                continue
            blobs = blobs or Blobs(store, f"{open_fs(self.root)[1]}/{part.session}", self.kind)
            values = blobs.raster(x[at], x[size], x["width"], x["height"])
            rows.append((part.session, x["frame"], x.get("t"), x["width"], x["height"], values))
            held += values.nbytes
            if held > 4 << 20:
                yield batch_of(rows)
                rows, held = [], 0
        if rows:
            yield batch_of(rows)


def lines_from(store: fs.FileSystem, path: str, start: int, end: int) -> Iterator[bytes]:
    """Lines of a file that begin from ``start`` to before ``end``, blank ones left out."""
    with store.open_input_file(path) as f:
        f.seek(max(0, start - 1))
        held = f.read(end - max(0, start - 1))
        while not held.endswith(b"\n") and (more := f.read(4096)):  # the last line may go on
            cut = more.find(b"\n")
            held += more if cut < 0 else more[: cut + 1]
    if start:  # a line that began before belongs to the range before
        held = held[held.find(b"\n") + 1 :] if b"\n" in held else b""
    return (x for x in held.split(b"\n") if x.strip())


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)


def rasters(spark: SparkSession, root: str, kind: str = "depth", **options: str) -> DataFrame:
    """Rasters of all sessions under ``root``; filters on session_id and frame reach the files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterSource)
    return spark.read.format("session_rasters").options(kind=kind, **options).load(root)


def indexed(root: str, index: DataFrame, kind: str) -> DataFrame:
    """Rasters of an index's rows (session_id, frame, t, width, height and the places), each task in the order of the blobs."""
    at, size, _ = KINDS[kind]
    rows = index.where(F.col(at).isNotNull()).select("session_id", F.col("frame").cast("bigint").alias("frame"), F.col("t").cast("double").alias("t"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.col(at).cast("bigint").alias("at"), F.col(size).cast("bigint").alias("size"))
    rows = rows.repartitionByRange("session_id", "at").sortWithinPartitions("session_id", "at")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_fs(root)
        now, blobs, out, held = None, None, [], 0
        for batch in batches:
            for x in batch.to_pylist():
                if x["session_id"] != now:
                    now = x["session_id"]
                    blobs = Blobs(store, f"{folder}/{now}", kind)
                values = blobs.raster(x["at"], x["size"], x["width"], x["height"])
                out.append((now, x["frame"], x["t"], x["width"], x["height"], values))
                held += values.nbytes
                if held > 4 << 20:
                    yield batch_of(out)
                    out, held = [], 0
        if out:
            yield batch_of(out)

    return rows.mapInArrow(task, SCHEMA)


# --- packing -----------------------------------------------------------------------


@dataclass
class Parts(WriterCommitMessage):
    """Files that a task has written: (in the job's folder, in the session's)."""

    moves: list[tuple[str, str]] = field(default_factory=list)


class PackedSink(DataSource):
    """Sessions' rasters as packed parts. Rows: session_id, line (index as JSON, without places), at, raw, confidence_at, confidence."""

    @classmethod
    def name(cls) -> str:
        return "packed_rasters"

    def schema(self) -> str:
        return "session_id string, line string, at bigint, raw binary, confidence_at bigint, confidence binary"

    def writer(self, schema, overwrite: bool) -> PackedWriter:
        return PackedWriter(self.options["path"])


class PackedWriter(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root, self.job = root, uuid.uuid4().hex

    @property
    def folder(self) -> str:
        return f"{open_fs(self.root)[1]}/.packing-{self.job}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Parts:
        """Rows come by session and offset; each run of a session is a part, named by its first offsets."""
        store, root = open_fs(self.root)
        context = TaskContext.get()
        own = f"{self.folder}/{context.taskAttemptId() if context else uuid.uuid4().hex}"
        store.create_dir(own)
        done, files, now = Parts(), {}, None

        def begin(session: str, at: int, confidence_at: int) -> None:
            put("index", f"{root}/{session}/depth/{at:020d}-{confidence_at:020d}.jsonl")
            put("depth", f"{root}/{session}/depth/{at:020d}.bin")

        def put(kind: str, to: str) -> None:
            path = f"{own}/{len(done.moves)}"
            files[kind] = store.open_output_stream(path)
            done.moves.append((path, to))

        def close() -> None:
            for f in files.values():
                f.close()
            files.clear()

        for batch in batches:
            for x in batch.to_pylist():
                if x["session_id"] != now:
                    close()
                    now = x["session_id"]
                    begin(now, x["at"], x["confidence_at"])
                line = json.loads(x["line"]) | {"offset": x["at"], "length": len(x["raw"])}
                files["depth"].write(x["raw"])
                if x["confidence"] is not None:
                    line |= {"confidenceOffset": x["confidence_at"], "confidenceLength": len(x["confidence"])}
                    if "confidence" not in files:
                        put("confidence", f"{root}/{now}/confidence/{x['confidence_at']:020d}.bin")
                    files["confidence"].write(x["confidence"])
                files["index"].write(json.dumps(line).encode() + b"\n")
        close()
        return done

    def commit(self, messages: list[Parts | None]) -> None:
        store, _ = open_fs(self.root)
        moves = [m for parts in messages if parts for m in parts.moves]
        for there in sorted({to.rsplit("/", 1)[0] for _, to in moves}):
            store.create_dir(there)
        for path, to in sorted(moves, key=lambda m: m[1].endswith(".jsonl")):  # what an index names is there before it
            store.move(path, to)
        self._clear(store)

    def abort(self, messages: list[Parts | None]) -> None:
        self._clear(open_fs(self.root)[0])

    def _clear(self, store: fs.FileSystem) -> None:
        if store.get_file_info(self.folder).type == fs.FileType.Directory:
            store.delete_dir(self.folder)


def encoded(rows: DataFrame) -> DataFrame:
    """``rows`` with ``values`` and ``confidence`` (arrays of numbers) as the bytes ``raw`` and ``confidence`` of their rasters."""
    names = [c for c in rows.columns if c not in ("values", "confidence")]
    kept = rows.select(*names, "values", F.col("confidence").cast("array<float>").alias("confidence"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [pa.array([None if v is None else np.asarray(v, kind).tobytes() for v in batch.column(len(names) + i).to_pylist()], pa.binary()) for i, kind in enumerate(("<f2", "u1"))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *raw], names=[*names, "raw", "confidence"])

    return kept.mapInArrow(task, ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names], "raw binary", "confidence binary"]))


def pack(rows: DataFrame, out: str, *, order: str = "ordinal", limit: int | None = None, width: float = 1e6) -> None:
    """Writes sessions' rasters as packed parts under ``out``, their offsets counted anew.

    ``rows`` has session_id, ``order`` (a number, unique in its session), line (the index row as JSON), raw and
    confidence (null without). ``limit`` keeps a session's first rasters. Sessions are dealt to tasks by
    ranges of order, so one of any size is written in parts.
    """
    from ..operators.ordered import cut, numbered, running

    places = numbered(rows, ["session_id"], [order], "__i", width=width)
    if limit:
        places = places.where(F.col("__i") < limit)
    sizes = {"at": F.length("raw"), "confidence_at": F.coalesce(F.length("confidence"), F.lit(0))}
    narrow = cut(places.select("session_id", order, *[c.cast("bigint").alias(f"size_{n}") for n, c in sizes.items()]))
    narrow = running(narrow, ["session_id"], [order], {n: F.col(f"size_{n}") for n in sizes}, inclusive=False, width=width)
    full = rows.select("session_id", order, "line", "raw", "confidence").join(narrow.select("session_id", order, *sizes), ["session_id", order])
    full = full.repartitionByRange("session_id", order).sortWithinPartitions("session_id", order)
    rows.sparkSession.dataSource.register(PackedSink)
    full.select("session_id", "line", "at", "raw", "confidence_at", "confidence").write.format("packed_rasters").mode("append").save(out)
