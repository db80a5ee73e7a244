"""Sessions as tables: line-delimited streams, manifests, rasters, listings.

All reads go through Spark's file sources, so any store that Spark reads will
do. A session's id is the name of its directory.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import indexed
from .schema import MANIFEST, STREAMS


def _session_of(path: Column, levels: int = 1) -> Column:
    return F.element_at(F.split(path, "/"), -1 - levels)


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _paths(root: str, file: str, many: bool | None) -> str:
    """A file of the session at ``root`` (``many`` false), of those in it (true), or whichever it is."""
    return {True: f"{root}/*/{file}", False: f"{root}/{file}", None: f"{root}/{{{file},*/{file}}}"}[many]


def stream(spark: SparkSession, root: str, name: str, *, many: bool | None = None) -> DataFrame:
    """Rows of one stream of all sessions under ``root``, or of the one at it.

    Blank and undecodable lines are skipped, a missing file is empty. Adds
    session_id and ordinal, which rises in file order.
    """
    schema = STREAMS[name]
    path = _paths(root, f"{name}.jsonl", many)
    try:
        raw = spark.read.schema(f"{schema}, _corrupt STRING").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return _empty(spark, f"session_id STRING, ordinal BIGINT, {schema}")
        raise
    rows = raw.select(
        _session_of(F.col("_metadata.file_path")).alias("session_id"),
        F.monotonically_increasing_id().alias("ordinal"),
        *[F.col(c) for c in raw.columns],
    )
    return rows.where("_corrupt is null and t is not null").drop("_corrupt")


def manifests(spark: SparkSession, root: str, *, many: bool | None = None) -> DataFrame:
    """Manifests with session_id; unreadable ones are left out. A single missing one is an error."""
    path = _paths(root, "manifest.json", many)
    raw = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    return raw.withColumn("session_id", _session_of(F.col("_metadata.file_path"))).where("id is not null")


def payload(spark: SparkSession, root: str) -> DataFrame:
    """All files of sessions, hidden ones left out: session_id, rel, bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    rel = F.regexp_replace("path", f"^.*?{_quoted(root.rstrip('/').rsplit('/', 1)[-1])}/", "")
    parts = F.split(rel, "/")
    out = files.select(F.get(parts, F.lit(0)).alias("session_id"), F.array_join(F.slice(parts, 2, 1000), "/").alias("rel"), F.col("length").alias("bytes"))
    return out.where(~F.rlike("rel", F.lit(r"(^|/)\."))).where("rel <> ''")


def _quoted(text: str) -> str:
    import re

    return re.escape(text)


def images(spark: SparkSession, root: str) -> DataFrame:
    """Image files (jpg, jpeg, png): path, bytes; content only if it is selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.where(F.rlike(F.lower("path"), F.lit(r"\.(jpg|jpeg|png)$"))).select("path", F.col("length").alias("bytes"), "content")


def rasters(spark: SparkSession, root: str, index: DataFrame, *, confidence: bool = False) -> DataFrame:
    """Depth (float16, decoded to float) or confidence (0, 1, 2) rasters of an index of frames.

    Each task seeks to its rows' offsets; no blob is read whole and offsets are 64-bit (``blobs``; its data source plans
    from the index files themselves). A raster that is cut short is an error.
    """
    return indexed(root, index, "confidence" if confidence else "depth")


def pixels(rasters: DataFrame) -> DataFrame:
    """Rows of pixels: v, u, z (null where there is no return)."""
    rows = rasters.select("session_id", "frame", "width", F.posexplode("values").alias("p", "z"))
    z = F.when(F.isnan("z") | (F.abs("z") == float("inf")), None).otherwise(F.col("z").cast("double"))
    return rows.select("session_id", "frame", F.floor(F.col("p") / F.col("width")).cast("int").alias("v"), (F.col("p") % F.col("width")).alias("u"), z.alias("z"))


def tum_poses(spark: SparkSession, path: str) -> DataFrame:
    """Pose text: eight numbers a line; comments and blank lines are skipped."""
    text = spark.read.text(path).where(~F.rlike("value", F.lit(r"^\s*(#|$)")))
    parts = F.split(F.trim("value"), r"\s+")
    names = ("t", "tx", "ty", "tz", "qx", "qy", "qz", "qw")
    return text.select(F.monotonically_increasing_id().alias("ordinal"), *[F.get(parts, F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])


def trajectory(df: DataFrame, by: str = "session_id", *, poses: tuple[str, ...] = ("estimate", "reference")) -> DataFrame:
    """``df`` if it has frame, t and poses of 16 numbers in every row, each session's frames are unique and its times rise; an error names what fails."""
    from ..operators.ordered import previous

    missing = sorted({by, "frame", "t", *poses} - set(df.columns))
    if missing:
        raise ValueError(f"missing fields: {', '.join(missing)}")
    fields = ["frame", "t", *poses]
    holes = df.select(*[F.count_if(F.col(c).isNull()).alias(c) for c in fields]).first()
    if any(holes):
        raise ValueError(f"fields without a value: {', '.join(c for c in fields if holes[c])}")
    for c in poses:
        if not df.where((F.size(c) != 16) | F.exists(c, lambda x: x.isNull())).isEmpty():
            raise ValueError(f"{c} has poses that are not 4 x 4")
    if not df.groupBy(by, "frame").count().where("count > 1").isEmpty():
        raise ValueError("frames occur more than once")
    if not previous(df, [by], ["frame"], {"__t": "t"}, width=1e5).where("t <= __t").isEmpty():
        raise ValueError("times do not rise with the frames")
    return df


def calibrations(spark: SparkSession, path: str) -> DataFrame:
    """Usable lens calibrations: those that have intrinsics and are not marked unavailable."""
    schema = "calibration STRING, intrinsics STRUCT<fx: DOUBLE, fy: DOUBLE, cx: DOUBLE, cy: DOUBLE>, width INT, height INT, lens_distortion_lookup_table ARRAY<DOUBLE>, inverse_lens_distortion_lookup_table ARRAY<DOUBLE>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw.where("coalesce(calibration, '') <> 'unavailable' and intrinsics is not null")


def log_values(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """First group of each pattern's first match in each whole log file; null without one."""
    text = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return log_extract(text, "value", patterns).drop("value")


#: What an odometry log says, by name (fixed values: formats of the log's lines).
LOG_PATTERNS: dict[str, str] = {
    "loop": r"end-start distance ([\d.]+) m \(ARKit ([\d.]+) m",
    "ate": r"rms ([\d.]+) cm\s+max ([\d.]+) cm",
    "travelled": r"ARKit travelled ([\d.]+) m over ([\d.]+) s",
    "rpe": r"translation\s+median ([\d.]+) cm\s+p90 ([\d.]+) cm",
    "rpe_rot": r"rotation\s+median ([\d.]+)°\s+p90 ([\d.]+)°",
    "frames": r"^(\S+): (\d+) depth frames",
    "keyframes": r"map: (\d+) keyframes of (\d+) frames, (\d+) with images \(([\d.]+)%\), (\d+) voxels",
    "photo": r"photometric: evaluated (\d+)/(\d+) frames \((\d+)%\), evaluations (\d+), accepted LM steps (\d+)",
    "photo_pairs": r"pairs (\d+) available/(\d+) selected/(\d+) solved",
    "photo_ref": r"photometric reference: (\S+) (\d+) frames, no reference (\d+) skipped",
    "photo_dist": r"photometric reference distance: median ([\d.]+) m\s+angle median ([\d.]+)°",
    "cond": r"frame-only conditioning\s+median ([\d.]+)\s+p10 ([\d.]+)\s+degenerate (\d+)/(\d+)",
    "residual": r"point-to-plane residual\s+estimate ([\d.]+) mm\s+arkit ([\d.]+) mm",
    "inliers": r"ICP inliers: median (\d+)%",
}
#: And its error bands of conditioning (a fixed value as well).
LOG_BAND = r"(cond < 0\.01|0\.01 <= cond < 0\.05|cond >= 0\.05)\s+(\d+) frames(?:\s+translation median ([\d.]+) cm p90 ([\d.]+) cm)?"


def odometry_logs(df: DataFrame, column: str) -> DataFrame:
    """Adds, for each of ``LOG_PATTERNS``, the groups of its first match as numbers (null without a match), and the error bands of conditioning.

    A group that may hold a word is also in ``<name>_text``; a word is no number, so it is null among them.
    """
    text = F.coalesce(F.col(column), F.lit(""))
    found = {}
    for name, p in LOG_PATTERNS.items():
        groups = p.count("(") - p.count("\\(")
        parts = F.array(*[F.regexp_extract(text, p, i + 1) for i in range(groups)])
        found[name] = F.when(F.rlike(text, F.lit(p)), F.transform(parts, lambda x: F.when(F.rlike(x, F.lit(r"^[0-9.]+$")), x.try_cast("double"))))
        if r"(\S+)" in p:
            found[f"{name}_text"] = F.when(F.rlike(text, F.lit(p)), parts)
    parts = [F.regexp_extract_all(text, F.lit(LOG_BAND), F.lit(i)) for i in (1, 2, 3, 4)]
    number = lambda c: F.when(c != "", c.cast("double"))
    bands = F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("band", "frames", "median", "p90"), strict=True)]), lambda b: F.struct(b["band"].alias("band"), b["frames"].cast("bigint").alias("frames"), number(b["median"]).alias("median_cm"), number(b["p90"]).alias("p90_cm")))
    return df.withColumns(found | {"bands": bands})


def log_extract(df: DataFrame, column: str, patterns: dict[str, str]) -> DataFrame:
    found = {n: F.regexp_extract(F.coalesce(F.col(column), F.lit("")), p, 1) for n, p in patterns.items()}
    return df.withColumns({n: F.when(c != "", c) for n, c in found.items()})
