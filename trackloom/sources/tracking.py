"""Readers of tracking text and JSON files. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom import schemas
from trackloom.functions.geometry import grid_to_cm
from trackloom.functions.names import camera_of_path


def read_mot(spark: SparkSession, path: str, fps: float = 1.0, classes: list[int] | None = None) -> DataFrame:
    """Detections of MOT files (frame,id,x,y,w,h,conf[,class,visibility]) with the camera from the file
    name and the time from the frame. Rows with fewer than seven fields go."""
    raw = spark.read.schema(schemas.MOT).csv(path, mode="PERMISSIVE").where("conf is not null and h is not null")
    out = raw.select(
        camera_of_path(F.col("_metadata.file_path")).alias("camera_id"), F.col("id").alias("track_id"), F.col("frame").alias("frame_id"),
        (F.col("frame") / F.lit(fps)).alias("timestamp"), "x", "y", "w", "h", F.col("conf").alias("confidence"), F.col("class").alias("class_id"),
    )
    return out.where(F.col("class_id").isin(classes)) if classes else out


def read_scored_mot(spark: SparkSession, path: str) -> DataFrame:
    """Rows for scoring: fewer than six fields go, confidence 0 goes, one that can't be read counts as 1."""
    parts = F.split("value", ",")
    cells = spark.read.text(path).select(parts.alias("c"), F.col("_metadata.file_path").alias("path")).where(F.size("c") >= 6)
    conf = F.coalesce(F.try_element_at("c", F.lit(7)).try_cast("double"), F.lit(1.0))
    names = ("frame_id", "track_id", "x", "y", "w", "h")
    return cells.select(
        camera_of_path(F.col("path")).alias("camera_id"),
        *[F.col("c")[k].try_cast("bigint" if k < 2 else "double").alias(n) for k, n in enumerate(names)],
        conf.alias("confidence"),
    ).where("confidence <> 0")


def read_aic(spark: SparkSession, path: str, class_id: int = 2) -> DataFrame:
    """White-space separated rows: camera id frame x y w h ...; at least seven fields, class fixed."""
    c = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(c.alias("c")).where(F.size("c") >= 7)
    names = ("track_id", "frame_id", "x", "y", "w", "h")
    return rows.select(F.col("c")[0].alias("camera_id"), *[F.col("c")[k + 1].try_cast("bigint" if k < 2 else "double").alias(n) for k, n in enumerate(names)], F.lit(class_id).alias("class_id"))


def read_tracklets(spark: SparkSession, path: str) -> DataFrame:
    """Tracklets as nested JSON lines."""
    return spark.read.schema(schemas.TRACKLETS).json(path)


def read_trajectories(spark: SparkSession, path: str) -> DataFrame:
    """Global trajectories; fields that older files lack get their defaults, and names may be in camel
    case."""
    schema = "global_id bigint, globalId bigint, confidence double, num_cameras bigint, tracklets array<struct<camera_id:string,track_id:bigint>>"
    raw = spark.read.schema(schema).json(path)
    return raw.select(
        F.coalesce("global_id", "globalId").alias("global_id"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("num_cameras", F.size(F.array_distinct(F.transform("tracklets", lambda t: t["camera_id"])))).cast("long").alias("num_cameras"), "tracklets",
    )


_PEOPLE = "array<struct<personID:bigint,positionID:bigint,views:array<struct<viewNum:int,xmin:double,ymin:double,xmax:double,ymax:double>>>>"


def frame_texts(spark: SparkSession, path: str) -> DataFrame:
    """(frame_id, value): texts of per-frame files; the frame is the number in a file's name."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"(\d+)", 1).cast("long").alias("frame_id"), "value")


def ground_truth(texts: DataFrame) -> DataFrame:
    """(frame_id, person_id, x_cm, y_cm) of per-frame JSON (frame_id, value): of several entries of a person the
    first, and only people whom a camera sees."""
    rows = texts.select("frame_id", F.posexplode(F.from_json("value", _PEOPLE)).alias("at", "p"))
    first = rows.groupBy("frame_id", F.col("p.personID").alias("person_id")).agg(F.min_by("p", "at").alias("p"))
    x, y = grid_to_cm(F.col("p.positionID"))
    visible = F.exists("p.views", lambda v: (v["xmin"] >= 0) & (v["xmax"] > v["xmin"]) & (v["ymax"] > v["ymin"]))
    return first.where(visible).select("frame_id", "person_id", x.alias("x_cm"), y.alias("y_cm"))


def ground_views(texts: DataFrame) -> DataFrame:
    """Boxes of per-frame JSON (frame_id, value), one row for each valid view; camera C1 is view 0."""
    rows = texts.select("frame_id", F.explode(F.from_json("value", _PEOPLE)).alias("p")).select("frame_id", F.col("p.personID").alias("track_id"), F.explode("p.views").alias("v"))
    ok = (F.col("v.xmin") >= 0) & (F.col("v.ymin") >= 0) & (F.col("v.xmax") > F.col("v.xmin")) & (F.col("v.ymax") > F.col("v.ymin"))
    return rows.where(ok).select("frame_id", "track_id", F.concat(F.lit("C"), F.col("v.viewNum") + 1).alias("camera_id"), "v.xmin", "v.ymin", "v.xmax", "v.ymax")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """People on the ground plane of per-frame JSON files."""
    return ground_truth(frame_texts(spark, path))


def read_ground_views(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of per-frame JSON files."""
    return ground_views(frame_texts(spark, path))
