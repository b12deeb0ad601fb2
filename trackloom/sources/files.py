"""Readers of manifests, matrices, ground-plane detections, calibrations, zones and polygons. Schemas are given,
never inferred; files are read by Spark, so paths may be in any store."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom import schemas
from trackloom.functions.geometry import grid_to_cm

#: Rows of a matrix that are passed on at once.
MATRIX_ROWS = 4096
#: Places of ground truth below a folder, and the fields of its rows.
TRUTH_PATTERNS = ("*.txt", "*/gt.txt", "*/gt/gt.txt")
#: Fields of ground-plane detections.
GROUND_FIELDS = "frame_id bigint, raw_frame_id bigint, x_world_cm double, y_world_cm double, x_grid double, y_grid double, score double"


def read_frame_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Frames of a manifest: a JSON list in one file, or JSON lines."""
    return spark.read.schema(schemas.FRAME_INFO).json(path, multiLine=True)


def matrix_rows(files: DataFrame) -> DataFrame:
    """(file, position, v): rows of .npy matrices (path, content), with their place in the file; a vector is one
    row. A file is read by one task and passed on in slices."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                matrix = np.atleast_2d(np.load(io.BytesIO(content), allow_pickle=False))
                flat = matrix.reshape(len(matrix), -1).astype(np.float64)
                for k in range(0, len(flat), MATRIX_ROWS):
                    part = flat[k : k + MATRIX_ROWS]
                    yield pd.DataFrame({"file": name.rsplit("/", 1)[-1], "position": np.arange(k, k + len(part)), "v": list(part)})

    return files.select("path", "content").mapInPandas(run, "file string, position long, v array<double>")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the .npy files at a path."""
    return matrix_rows(spark.read.format("binaryFile").load(path))


def with_queries(index: DataFrame, tensors: DataFrame | None) -> DataFrame:
    """index (position, ...) with the query vectors (position, queries) of the same place; without a tensor all
    are null, and rows of it beyond the index go."""
    if tensors is None:
        return index.withColumn("queries", F.lit(None).cast("array<array<double>>"))
    return index.join(tensors.select("position", "queries"), "position", "left")


def _normal_frame(frame: Column) -> Column:
    """Numbers of files that count in steps of five."""
    return F.when(frame >= 5, F.floor(frame / 5)).otherwise(frame).cast("long")


def read_ground_detections(spark: SparkSession, path: str, kind: str, normalize: bool = True, lines: bool = False) -> DataFrame:
    """(frame_id, raw_frame_id, x_cm, y_cm, score) of ground-plane detections. txt: frame and grid cell, parted by
    blanks or commas; rows with fewer than three numbers go. csv (with a header) and json: frame_id and
    centimetres or a grid cell, raw_frame_id and score where given; JSON is a list in
    one file, or `lines`. Frames from 5 on count in steps of five unless raw_frame_id is given."""
    if kind == "txt":
        cells = F.filter(F.split(F.trim("value"), r"[\s,]+"), lambda c: c != "")
        rows = spark.read.text(path).select(cells.alias("c")).where(F.size("c") >= 3)
        number = [F.col("c")[k].cast("double") for k in range(3)]
        raw = rows.select(number[0].cast("long").alias("raw"), F.lit(None).cast("long").alias("given"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), number[1].alias("gx"), number[2].alias("gy"), F.lit(1.0).alias("score"))
    elif kind in ("csv", "json"):
        read = spark.read.schema(GROUND_FIELDS)
        rows = _csv_by_name(spark, path) if kind == "csv" else read.json(path, multiLine=not lines)
        raw = rows.select(F.col("frame_id").alias("raw"), F.col("raw_frame_id").alias("given"), F.col("x_world_cm").alias("x"), F.col("y_world_cm").alias("y"), F.col("x_grid").alias("gx"), F.col("y_grid").alias("gy"), F.coalesce("score", F.lit(1.0)).alias("score"))
    else:
        raise ValueError(f"unknown kind of detections {kind}: one of txt, csv, json")
    (x0, y0), step = (-300.0, -900.0), 2.5
    frame = F.when(F.col("given").isNull() & F.lit(normalize), _normal_frame(F.col("raw"))).otherwise(F.col("raw"))
    known = F.col("x").isNotNull() & F.col("y").isNotNull()
    return raw.select(
        frame.alias("frame_id"), F.coalesce("given", "raw").alias("raw_frame_id"),
        F.when(known, F.col("x")).otherwise(x0 + F.col("gx") * step).alias("x_cm"), F.when(known, F.col("y")).otherwise(y0 + F.col("gy") * step).alias("y_cm"), "score",
    )


def _csv_by_name(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files by the names in their header, with nulls for fields of GROUND_FIELDS that it lacks."""
    rows = spark.read.option("header", True).csv(path)
    fields = [f.split() for f in GROUND_FIELDS.split(", ")]
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def _matrix(name: str) -> Column:
    """The numbers of an element of an XML text in column value: those of its data, or its own."""
    data = F.coalesce(F.nullif(F.expr(f"xpath_string(value, '//{name}/data')"), F.lit("")), F.expr(f"xpath_string(value, '//{name}')"))
    return F.transform(F.filter(F.split(F.trim(data), r"\s+"), lambda c: c != ""), lambda c: c.cast("double"))


def calibration(intrinsic: DataFrame, extrinsic: DataFrame) -> DataFrame:
    """(camera, k array of 9, rvec array of 3, tvec array of 3, r array of 9) of XML texts (camera, value); a camera
    that lacks one of the two is left out. r is the rotation of rvec."""
    inner = intrinsic.select("camera", _matrix("camera_matrix").alias("k"))
    outer = extrinsic.select("camera", _matrix("rvec").alias("rvec"), _matrix("tvec").alias("tvec"))
    return inner.join(outer, "camera").withColumn("r", rotation(F.col("rvec")))


def read_calibration(spark: SparkSession, intrinsic: str, extrinsic: str) -> DataFrame:
    """Calibrations in files intr_<camera>.xml and extr_<camera>.xml."""
    name = F.regexp_extract("_metadata.file_name", r"^(?:intr|extr)_(.+)\.xml$", 1).alias("camera")
    return calibration(*[spark.read.text(path, wholetext=True).select(name, "value") for path in (intrinsic, extrinsic)])


def rotation(rvec: Column) -> Column:
    """The nine entries of the rotation about a vector by its length, row by row."""
    x, y, z = rvec[0], rvec[1], rvec[2]
    angle = F.sqrt(x * x + y * y + z * z)
    n = F.greatest(angle, F.lit(1e-12))
    a, b, c = x / n, y / n, z / n
    s, k = F.sin(angle), 1 - F.cos(angle)
    return F.array(
        1 - k * (b * b + c * c), k * a * b - s * c, k * a * c + s * b,
        k * a * b + s * c, 1 - k * (a * a + c * c), k * b * c - s * a,
        k * a * c - s * b, k * b * c + s * a, 1 - k * (a * a + b * b),
    )


def read_truth_boxes(spark: SparkSession, folder: str, patterns: tuple[str, ...] = TRUTH_PATTERNS, by_folder: bool = False) -> DataFrame:
    """(camera_id, frame_id, track_id, x, y, w, h) of ground truth below a folder; a file that several patterns meet is
    read once. The camera is the file's name; for gt.txt, or by_folder, the folder's above it and gt."""
    found = None
    for k, pattern in enumerate(patterns):
        try:
            rows = spark.read.text(f"{folder.rstrip('/')}/{pattern}").select("value", F.col("_metadata.file_path").alias("path"), F.lit(k).alias("k"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return spark.createDataFrame([], "camera_id string, frame_id long, track_id long, x double, y double, w double, h double")
    first = found.groupBy("path").agg(F.min("k").alias("k"))
    parts = F.split("path", "/")
    last, up, top = (F.element_at(parts, -k) for k in (1, 2, 3))
    camera = F.when((last != "gt.txt") & ~F.lit(by_folder), F.regexp_replace(last, r"\.[^.]*$", "")).when(up == "gt", top).otherwise(up)
    c = F.split("value", ",")
    names = ("frame_id", "track_id", "x", "y", "w", "h")
    once = found.join(first, ["path", "k"]).where(F.size(c) >= 6)
    return once.select(camera.alias("camera_id"), *[c[k].try_cast("bigint" if k < 2 else "double").alias(n) for k, n in enumerate(names)])


_CENTERS = "struct<centers:array<array<double>>>"


def read_zones(spark: SparkSession, path: str, min_count: int = 2) -> tuple[DataFrame, DataFrame]:
    """(centres, transitions) of a zone file: (camera_id, side, zone, cx, cy), and (key, count) of transitions seen at
    least min_count times."""
    schema = f"cameras map<string,struct<entry_zones:{_CENTERS},exit_zones:{_CENTERS}>>, transitions map<string,bigint>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    cameras = raw.select(F.explode("cameras").alias("camera_id", "z"))
    sides = cameras.select("camera_id", F.explode(F.map_from_arrays(F.array(F.lit("entry"), F.lit("exit")), F.array("z.entry_zones.centers", "z.exit_zones.centers"))).alias("side", "c"))
    centres = sides.select("camera_id", "side", F.posexplode("c").alias("zone", "p")).select("camera_id", "side", "zone", F.col("p")[0].alias("cx"), F.col("p")[1].alias("cy"))
    return centres, raw.select(F.explode("transitions").alias("key", "count")).where(F.col("count") >= min_count)


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """(camera_id, place, x, y): the corners of each camera's polygon in a JSON object."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<array<double>>>")).alias("camera_id", "p"))
    return raw.select("camera_id", F.posexplode("p").alias("place", "p")).select("camera_id", "place", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def read_position_cells(rows: DataFrame, position: str) -> DataFrame:
    """Rows with the centimetres of their grid cell."""
    x, y = grid_to_cm(F.col(position))
    return rows.withColumns({"x_cm": x, "y_cm": y})
