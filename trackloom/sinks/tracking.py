"""Writers of trajectory tables: text for submissions, JSON lines and CSV. Large tables are written by
all tasks, one folder for each camera where readers expect that."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _number(c: str):
    return F.round(c, 6).cast("string")


def mot_lines(rows: DataFrame, frame_shift: int = 0) -> DataFrame:
    """(camera_id, frame_id, line): frame,id,x,y,w,h,conf,class,-1."""
    line = F.concat_ws(",", F.col("frame_id") + frame_shift, "track_id", *[_number(c) for c in ("x", "y", "w", "h", "confidence")], "class_id", F.lit(-1))
    return rows.select("camera_id", "frame_id", "track_id", line.alias("line"))


def write_mot(rows: DataFrame, path: str, frame_shift: int = 0) -> None:
    """One folder camera_id=... for each camera, lines by frame and id in each file."""
    lines = mot_lines(rows, frame_shift).repartition("camera_id", "frame_id").sortWithinPartitions("camera_id", "frame_id", "track_id")
    lines.select("line", "camera_id").write.partitionBy("camera_id").text(path)


def aic_lines(rows: DataFrame) -> DataFrame:
    """line: camera id frame x y w h -1 -1."""
    return rows.select(F.concat_ws(" ", "camera_id", "track_id", "frame_id", *[_number(c) for c in ("x", "y", "w", "h")], F.lit("-1 -1")).alias("line"))


def write_aic(rows: DataFrame, path: str) -> None:
    """Submission lines, sorted as strings over all files."""
    aic_lines(rows).orderBy("line").write.text(path)


def nested_tracklets(rows: DataFrame) -> DataFrame:
    """Tracklets with their frames as an array by frame."""
    box = F.struct(F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    frame = F.struct("frame_id", F.col("frame_id").cast("double").alias("timestamp"), box.alias("bbox"), "confidence")
    return rows.groupBy("camera_id", "track_id").agg(F.min("class_id").cast("int").alias("class_id"), F.array_sort(F.collect_list(frame)).alias("frames"))


def write_tracklets(rows: DataFrame, path: str) -> None:
    nested_tracklets(rows).write.json(path)


def box_samples(tracklets: DataFrame) -> DataFrame:
    """Every step-th frame of each tracklet, step = max(1, n // 5)."""
    step = F.greatest(F.lit(1), F.floor(F.size("frames") / 5)).cast("int")
    return tracklets.withColumn("samples", F.filter("frames", lambda f, k: k % step == 0))


def flat_tracklets(stats: DataFrame) -> DataFrame:
    """One row for each tracklet with two decimals, for CSV."""
    return stats.select("camera_id", "track_id", "start_frame", "end_frame", "num_frames", F.round("mean_confidence", 2).alias("mean_confidence"), F.round("duration", 2).alias("duration"))


def upserted(table: DataFrame, rows: DataFrame, key: str, version: str) -> DataFrame:
    """The table after rows: for each key the row of the highest version."""
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return table.unionByName(rows).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def forensic_report(trajectories: DataFrame, min_confidence: float) -> DataFrame:
    """Trajectories from the confidence on with their place by confidence, then id."""
    kept = trajectories.where(F.col("confidence") >= min_confidence)
    return kept.select("global_id", F.round("confidence", 4).alias("confidence"), "num_cameras").orderBy(F.desc("confidence"), "global_id")
