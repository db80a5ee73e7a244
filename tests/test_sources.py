"""Readers and writers of sessions, and the streaming forms."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar.operators import changelog, joins, quality, timeops
from veldspar.sources import session, sinks, synthetic
from veldspar.streaming import stateful


@pytest.fixture()
def root(tmp_path):
    d = tmp_path / "sessions" / "20260101-000000-abcdef"
    d.mkdir(parents=True)
    (d / "manifest.json").write_text(json.dumps({"schemaVersion": 1, "id": d.name, "clockAnchor": 5.0, "counts": {"pose": 3, "events": 9}, "config": {"captureMode": "stills", "recordDepth": True, "recordConfidence": False}}, indent=1))
    (d / "pose.jsonl").write_text('{"t": 1.0, "frame": 0, "tx": 0.0}\n\n{"t": 2.0, "frame": 1, "tx": 1.0, "unknown": 4}\nnot json\n{"t": 3.0, "frame": 2, "tx"')
    raster = np.array([[1.0, np.inf, 0.5], [2.0, np.nan, 4.0]], "<f2")
    (d / "depth.bin").write_bytes(raster.tobytes() * 2)
    (d / "depth.jsonl").write_text("".join(json.dumps({"t": float(i), "frame": i, "offset": 12 * i, "length": 12, "width": 3, "height": 2}) + "\n" for i in range(2)))
    (d / ".complete").write_text("")
    (d / "stills").mkdir()
    (d / "stills" / "a.jpg").write_bytes(b"x" * 7)
    return str(tmp_path / "sessions")


def test_streams_skip_torn_lines(spark, root):
    pose = session.stream(spark, root, "pose")
    assert [(r.session_id, r.frame, r.tx) for r in pose.orderBy("ordinal").collect()] == [("20260101-000000-abcdef", 0, 0.0), ("20260101-000000-abcdef", 1, 1.0)]
    assert session.stream(spark, root, "location").count() == 0
    depth = session.stream(spark, root, "depth")
    assert depth.where("cond is null and confidenceOffset is null").count() == 2


def test_manifest_counts_and_expected_files(spark, root):
    m = session.manifests(spark, root)
    declared = m.select("session_id", F.explode("counts").alias("stream", "declared"))
    actual = session.stream(spark, root, "pose").select("session_id", F.lit("pose").alias("stream"))
    out = quality.count_reconcile(actual, declared, ["session_id"]).collect()
    assert [(r.stream, r.actual, r.declared, r.agrees) for r in out] == [("pose", 2, 3, False)]
    assert quality.expected_files(m).first().expected == 10
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        session.manifests(spark, root + "/missing", many=False).count()


def test_rasters_and_short_ones(spark, root):
    index = session.stream(spark, root, "depth")
    px = session.pixels(session.rasters(spark, root, index)).where("frame = 1").orderBy("v", "u").collect()
    assert [r.z for r in px] == [1.0, None, 0.5, 2.0, None, 4.0]
    long = index.withColumn("length", F.lit(99).cast("bigint"))
    with pytest.raises(Exception, match="cut short"):
        session.rasters(spark, root, long).collect()


def test_payload_hides_dotfiles(spark, root):
    got = {r.rel: r.bytes for r in session.payload(spark, root).collect()}
    assert ".complete" not in got and got["stills/a.jpg"] == 7 and "pose.jsonl" in got
    assert session.images(spark, root).count() == 1


def test_tum_round_trip_and_packing(spark, tmp_path):
    tables = synthetic.build(spark)
    lines = sinks.tum_lines(tables["pose"].where("frame < 30"), ["session_id"], ["t"])
    sinks.write_episodes(lines.withColumnRenamed("session_id", "episode"), str(tmp_path / "ep"), "episode")
    back = session.tum_poses(spark, str(tmp_path / "ep" / "*"))
    assert back.count() == 30 and abs(back.agg(F.max("tx")).first()[0] - 0.29) < 1e-8
    packed = sinks.packed_index(tables["depth"], ["session_id"], ["t"], limit=3).orderBy("t").collect()
    assert [r.new_offset for r in packed] == [0, 98304, 196608]
    kept = tables["depth"].where("frame <= 24")
    assert sinks.packed_poses(tables["pose"], kept, ["session_id"]).count() == 25


def test_generated_session_answers(spark):
    t = synthetic.build(spark, interruption=True)
    posed = joins.posed_images(t["frames"], t["pose"], ["session_id"])
    assert posed.count() == 100 and posed.where("tracking = 'normal'").count() == 96
    planes = changelog.compact(t["planes"], ["session_id"], key="id", order=["ordinal"])
    assert planes.count() == 4
    floor = planes.where("classification = 'floor'").agg(F.avg("ty")).first()[0]
    assert abs(t["pose"].agg(F.avg("ty")).first()[0] - floor - 1.15) < 1e-9
    assert timeops.gaps(t["location"], ["session_id"]).count() == 0
    breaks = t["events"].where("kind = 'ar.interrupted'")
    seg = timeops.segments(posed.select("session_id", "t", "frame"), breaks.select("session_id", "t"), ["session_id"], order=["frame"])
    assert {r.segment: r["count"] for r in seg.groupBy("segment").count().collect()} == {0: 50, 1: 50}


def test_trajectory_validation(spark):
    p = [1.0] * 16
    ok = spark.createDataFrame([("a", 0, 0.0, p, p), ("a", 1, 1.0, p, p)], "session_id string, frame bigint, t double, estimate array<double>, reference array<double>")
    assert session.trajectory(ok).count() == 2
    bad = {
        "more than once": [("a", 0, 0.0, p, p), ("a", 0, 1.0, p, p)],
        "do not rise": [("a", 0, 1.0, p, p), ("a", 1, 1.0, p, p)],
        "without a value: estimate": [("a", 0, 1.0, None, p)],
        "reference has poses": [("a", 0, 1.0, p, p[:9])],
        "estimate has poses": [("a", 0, 1.0, [*p[:15], None], p)],
    }
    for message, rows in bad.items():
        with pytest.raises(ValueError, match=message):
            session.trajectory(spark.createDataFrame(rows, ok.schema))
    with pytest.raises(ValueError, match="missing fields: reference, t"):
        session.trajectory(ok.drop("t", "reference"))


def test_a_session_or_a_folder_of_sessions(spark, root):
    one = f"{root}/20260101-000000-abcdef"
    assert session.manifests(spark, one).count() == session.manifests(spark, root).count() == 1
    assert session.stream(spark, one, "pose").count() == session.stream(spark, root, "pose").count() == 2
    assert {r.session_id for r in session.stream(spark, one, "pose").collect()} == {"20260101-000000-abcdef"}


def test_streaming_gate_equals_batch(spark, tmp_path):
    times = [0.0, 0.05, 0.11, 0.19, 0.2, 0.9, 0.95, 1.0]
    schema = "s string, t double, i bigint"
    rows = spark.createDataFrame([("a", t, i) for i, t in enumerate(times)], schema)
    want = sorted(r.i for r in timeops.rate_gate(rows, ["s"], order=["i"], hz=10.0).where("fires").collect())
    for k, part in enumerate((rows.where("i < 4"), rows.where("i >= 4"))):
        part.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        run = stateful.rate_gate(source, "s", hz=10.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        run.awaitTermination(120)
    assert sorted(r.i for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want
