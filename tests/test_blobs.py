"""Rasters by byte range, and packed parts read back."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar.sources import blobs, session

W, H = 4, 3


def depth_of(s, frame):
    return ((np.arange(W * H) * 7 + 31 * frame + 100 * s) % 512).astype("<f2") / 4


def confidence_of(s, frame):
    return ((np.arange(W * H) + frame + s) % 3).astype("u1")


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("blobs") / "sessions"
    for s in range(3):
        d = top / f"s{s}"
        d.mkdir(parents=True)
        lines, depth, confidence = [], b"", b""
        for frame in range(40):
            x = {"t": frame / 10, "frame": frame, "offset": len(depth), "length": 2 * W * H, "width": W, "height": H, "note": "é" * (frame % 5)}
            if frame % 3:
                x |= {"confidenceOffset": len(confidence), "confidenceLength": W * H}
                confidence += confidence_of(s, frame).tobytes()
            lines.append(json.dumps(x, ensure_ascii=False))
            depth += depth_of(s, frame).tobytes()
        (d / "depth.bin").write_bytes(depth)
        (d / "confidence.bin").write_bytes(confidence)
        (d / "depth.jsonl").write_text("\n".join(lines[:20]) + "\n\nnot json\n" + "\n".join(lines[20:]) + '\n{"torn": ')
    return str(top)


def check(rows, of, frames):
    assert {(r.session_id, r.frame) for r in rows} == {(f"s{s}", f) for s in range(3) for f in frames}
    assert len(rows) == 3 * len(frames)
    for r in rows:
        assert r["values"] == of(int(r.session_id[1]), r.frame).astype(float).tolist() and r.t == r.frame / 10


@pytest.mark.parametrize("size", ["64", "700", "100000"])
def test_source_reads_every_raster_once(spark, root, size):
    check(blobs.rasters(spark, root, indexBytes=size).collect(), depth_of, range(40))
    check(blobs.rasters(spark, root, "confidence", indexBytes=size).collect(), confidence_of, [f for f in range(40) if f % 3])


def test_filters_reach_the_files(spark, root):
    df = blobs.rasters(spark, root, indexBytes="300").where("session_id in ('s1') and frame > 3 and frame <= 6")
    assert [(r.session_id, r.frame) for r in df.orderBy("frame").collect()] == [("s1", 4), ("s1", 5), ("s1", 6)]
    reader = blobs.RasterReader({"path": root})
    kept = list(reader.pushFilters([blobs.In(("session_id",), ("s1", "s2")), blobs.EqualTo(("frame",), 9), blobs.EqualTo(("t",), 0.9)]))
    assert kept == [blobs.EqualTo(("t",), 0.9)]
    assert {p.session for p in reader.partitions()} == {"s1", "s2"}
    assert [b.column("frame").to_pylist() for p in reader.partitions() for b in reader.read(p)] == [[9], [9]]


def test_a_blob_of_three_gigabytes(spark, tmp_path):
    d = tmp_path / "sessions" / "big"
    d.mkdir(parents=True)
    at = 3_000_000_000
    with open(d / "depth.bin", "wb") as f:
        f.seek(at)
        f.write(depth_of(1, 2).tobytes())
    x = {"t": 0.2, "frame": 2, "offset": at, "length": 2 * W * H, "width": W, "height": H}
    (d / "depth.jsonl").write_text(json.dumps(x) + "\n")
    root = str(tmp_path / "sessions")
    for df in (blobs.rasters(spark, root), session.rasters(spark, root, session.stream(spark, root, "depth"))):
        (r,) = df.collect()
        assert r["values"] == depth_of(1, 2).astype(float).tolist()
    (d / "depth.jsonl").write_text(json.dumps(x | {"offset": at + 2}) + "\n")
    with pytest.raises(Exception, match="cut short"):
        blobs.rasters(spark, root).collect()


def rows_to_pack(spark, root):
    index = session.stream(spark, root, "depth").select("session_id", "ordinal", "t", "frame", "width", "height")
    depth = blobs.rasters(spark, root).select("session_id", "frame", "values")
    confidence = blobs.rasters(spark, root, "confidence").select("session_id", "frame", F.col("values").alias("confidence"))
    rows = index.join(depth, ["session_id", "frame"]).join(confidence, ["session_id", "frame"], "left")
    line = F.to_json(F.struct("t", "frame", "width", "height"))
    return blobs.encoded(rows.select("session_id", F.col("frame").alias("ordinal"), line.alias("line"), "values", "confidence"))


@pytest.mark.parametrize("limit", [None, 11])
def test_packed_sessions_read_back(spark, root, tmp_path, limit):
    out = str(tmp_path / "packed")
    blobs.pack(rows_to_pack(spark, root), out, limit=limit, width=9.0)
    frames = range(limit or 40)
    check(blobs.rasters(spark, out, indexBytes="200").collect(), depth_of, frames)
    check(blobs.rasters(spark, out, "confidence").collect(), confidence_of, [f for f in frames if f % 3])
    lines = [json.loads(x) for p in sorted((tmp_path / "packed" / "s1" / "depth").glob("*.jsonl")) for x in p.read_text().splitlines()]
    assert [x["offset"] for x in lines] == [2 * W * H * i for i in frames]
    assert not list((tmp_path / "packed").glob(".packing*"))
    index = spark.createDataFrame([("s1", x["frame"], x["t"], W, H, x["offset"], x["length"]) for x in lines[3:6]], "session_id string, frame bigint, t double, width int, height int, offset bigint, length bigint")
    assert {r.frame for r in session.rasters(spark, out, index).collect()} == {3, 4, 5}


def test_lost_and_repeated_tasks_leave_nothing(tmp_path):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"session_id": "s", "line": '{"frame": 0}', "at": 0, "raw": b"ab", "confidence_at": 0, "confidence": None}])
    writer = blobs.PackedWriter(str(tmp_path / "out"))
    writer.write(iter([batch]))  # a task whose executor was lost
    done = writer.write(iter([batch]))
    writer.commit([done, None])
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file()) == [f"s/depth/{0:020d}-{0:020d}.jsonl", f"s/depth/{0:020d}.bin"]
    other = blobs.PackedWriter(str(tmp_path / "failed"))

    def broken():
        yield batch
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        other.write(broken())
    other.abort([None])
    assert not [p for p in (tmp_path / "failed").rglob("*") if p.is_file()]
