"""Helpers used by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space; words of most operators are the runs between it.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and runs on one machine, as in tests, a temporary
    folder is made and set; a cluster without one is refused.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="veldspar-")
    sc.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


#: What a batch between the JVM and Python may hold while a table is cut; blocks of sets are large rows.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """``BATCH`` holds for what is run inside."""
    before = spark.conf.get(BATCH[0])
    spark.conf.set(*BATCH)
    try:
        yield
    finally:
        spark.conf.set(BATCH[0], before)


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder, without its lineage.

    A table rather than checkpoint(): the latter hands on the constraints of the
    plan, which grow with every round of an iteration until planning stalls.
    """
    spark, schema = df.sparkSession, df.schema
    path = fresh_dir(spark, "cut")
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.__dict__["cut_path"] = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table of a ``cut`` that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.__dict__["cut_path"])
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def require(df: DataFrame, *columns: str) -> None:
    """Raise unless ``df`` has the named columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")


def spare(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pieces(batch: pa.RecordBatch, column: int, rows: int = 512, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, of so many rows and about so many bytes of text in ``column`` at most."""
    lo = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if i > lo and (i - lo >= rows or held + n > size):
            yield batch.slice(lo, i - lo)
            lo, held = i, 0
        held += n
    if lo < batch.num_rows:
        yield batch.slice(lo)


#: Caches that worker processes keep between tasks.
_CACHES: list[dict] = []


def worker_cache(cache: dict) -> dict:
    """``cache``, emptied as soon as another operator's tasks run in the same worker."""
    _CACHES.append(cache)
    return cache


def holding(cache: dict | None) -> None:
    """Called by a task: what other operators left in this worker goes."""
    for other in _CACHES:
        if other is not cache:
            other.clear()


class Numbered(dict):
    """Strings numbered as they first come; ``fresh`` has those not settled yet.

    It starts afresh (``trim``) beyond ``most`` strings or ``most_chars``
    characters, so its memory is bounded.
    """

    def __init__(self, most: int = 1_000_000, most_chars: int = 20_000_000):
        super().__init__()
        self.fresh: list[str] = []
        self.most, self.most_chars, self.chars = most, most_chars, 0

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.fresh.append(key)
        self.chars += len(key)
        return n

    def numbers(self, strings: Iterable[str]) -> list[int]:
        return list(map(self.__getitem__, strings))

    def settle(self, with_these: Callable[[list[str]], None]) -> None:
        if self.fresh:
            with_these(self.fresh)
            self.fresh = []

    def full(self) -> bool:
        return len(self) > self.most or self.chars > self.most_chars

    def trim(self, kept: Sequence[int] = ()) -> None:
        """All strings go but those of these numbers, which are numbered anew in this order."""
        strings = list(self) if kept else []
        stay = [strings[k] for k in kept]
        self.clear()
        self.update(zip(stay, range(len(stay)), strict=True))
        self.chars = sum(map(len, stay))
