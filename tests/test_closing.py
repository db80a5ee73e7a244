"""Sessions closed by timers, over restarts and late files, against the batch form."""

import json

import pytest

from veldspar.operators import changelog
from veldspar.streaming import closing

SCHEMA = "session_id string, rel string, ts timestamp, expected bigint"


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    part = folder / f".{name}"
    part.write_text("".join(json.dumps(dict(zip(("session_id", "rel", "ts", "expected"), (s, r, f"2026-01-01T00:00:{t:06.3f}Z", e), strict=True))) + "\n" for s, r, t, e in rows))
    part.rename(folder / f"{name}.json")


def run(spark, folder, name, **options):
    """Takes all files there are, in one stream with a checkpoint; what it has given since it first began."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))
    out = closing.session_closings(rows.where("rel is not null"), rows.where("expected is not null"), **options)
    made = folder.parent / f"out-{name}"
    query = out.writeStream.format("json").option("checkpointLocation", str(folder.parent / f"checkpoint-{name}")).option("path", str(made)).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    if query.exception():
        raise query.exception()
    got = spark.read.schema(closing.OUT).json(str(made)).collect()
    return sorted((r.session_id, r.kind, round(r.at.second + r.at.microsecond / 1e6, 3), r.files, r.expected, r.verdict) for r in got)


@pytest.fixture()
def two_cores(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_closing_over_restarts_and_late_files(two_cores, tmp_path):
    spark, folder = two_cores, tmp_path / "in"
    put(folder, "a", [("s", "1", 1.0, None), ("s", "2", 2.0, None), ("s", "2", 3.0, None), ("t", "1", 2.0, None), ("s", None, 1.0, 3), ("u", None, 1.0, 2)])
    put(folder, "b", [("other", "x", 20.0, None)])  # time goes on
    put(folder, "c", [("other", "y", 21.0, None)])
    first = run(spark, folder, "x")
    assert first == [("s", "closed", 9.001, 2, 3, "INCOMPLETE"), ("t", "closed", 8.001, 1, None, "unknown")]
    # The stream ends and begins again; a file after the close arms the session anew, a repeated one doesn't.
    put(folder, "d", [("s", "3", 22.0, None), ("t", "1", 22.0, None)])
    put(folder, "e", [("other", "z", 40.0, None)])
    put(folder, "f", [("other", "w", 41.0, None)])
    again = run(spark, folder, "x")
    assert again == sorted([*first, ("s", "closed", 28.001, 3, 3, "complete"), ("other", "closed", 27.001, 2, None, "unknown")])


def test_equal_to_the_batch_form(two_cores, tmp_path):
    spark, folder = two_cores, tmp_path / "in"
    rows = [(s, str(i), t, None) for s, times in {"a": [0, 1, 6.5, 7, 12], "b": [0.5, 3], "c": [2]}.items() for i, t in enumerate(times)]
    put(folder, "a", rows)
    put(folder, "b", [("end", "x", 58.0, None)])
    put(folder, "c", [("end", "y", 59.0, None)])
    got = {r[0]: r[2:4] for r in run(spark, folder, "x")}
    batch = changelog.idle_sessions(spark.createDataFrame([(s, float(t)) for s, _, t, _ in rows], "s string, t double"), ["s"], quiet=6.0).collect()
    assert got == {r.s: (round(r.end + 6.001, 3), r.rows) for r in batch}


def test_heartbeats(two_cores, tmp_path):
    spark, folder = two_cores, tmp_path / "in"
    put(folder, "a", [("s", str(i), float(i), None) for i in range(0, 12, 2)])
    put(folder, "b", [("end", "x", 30.0, None)])
    put(folder, "c", [("end", "y", 31.0, None)])
    put(folder, "d", [("end", "z", 32.0, None)])
    got = [(k, at) for s, k, at, *_ in run(spark, folder, "x", heartbeat_seconds=5.0) if s == "s"]
    assert ("closed", 16.001) in got and got.count(("closed", 16.001)) == 1
    assert [at for k, at in got if k == "heartbeat"][:1] == [5.0]
