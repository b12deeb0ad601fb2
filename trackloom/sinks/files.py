"""Writers of submissions, exports, matrices and ground-plane tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.tracklets import best_per_frame, suppressed, top_per_frame
from trackloom.operators.vectors import uniform_queries
from trackloom.sinks.tracking import write_mot


def submission(rows: DataFrame, min_confidence: float = 0.0, max_iou: float = 0.5, per_frame: int = 0, roi: Column | None = None) -> DataFrame:
    """The boxes of a submission, from detections with identities as track_id: confidence above the least (so
    interpolated ones, of 0, go), a positive size, inside the region `roi` (a condition that is null for points
    without a place), one box for an identity and frame, the per_frame most confident of a frame (0: all), and
    of boxes that overlap by more than max_iou the most confident."""
    kept = rows.where((F.col("confidence") > min_confidence) & (F.col("w") > 0) & (F.col("h") > 0))
    if roi is not None:
        kept = kept.where(F.coalesce(roi, F.lit(False)))
    kept = best_per_frame(kept)
    if per_frame:
        kept = top_per_frame(kept, per_frame).drop("place")
    return suppressed(kept, max_iou)


def write_submission(rows: DataFrame, path: str, **options) -> None:
    """MOT lines of the submission, frames counted from 1, in a folder for each camera."""
    write_mot(submission(rows, **options).withColumn("class_id", F.lit(1)), path, frame_shift=1)


def write_queries(rows: DataFrame, path: str) -> None:
    """Query tensors (position, queries), which must agree in shape, as Parquet."""
    uniform_queries(rows, ["position"]).select("position", "queries").write.parquet(path)


def export_lines(trajectories: DataFrame | None, detections: DataFrame, kind: str) -> DataFrame:
    """(line, order columns) of an export. csv: trajectories (global_id, num_cameras, total_duration, confidence),
    or tracklets where there are none; mot: all boxes; json: trajectories or tracklets as objects."""
    by = ["camera_id", "track_id"]
    stats = detections.groupBy(*by).agg(F.count("*").alias("numFrames"), F.min("frame_id").alias("startFrame"), F.max("frame_id").alias("endFrame"))
    if kind == "mot":
        two = [F.format_string("%.2f", c) for c in "xywh"]
        line = F.concat_ws(",", "frame_id", "track_id", *two, F.format_string("%.4f", "confidence"), F.lit("-1,-1,-1"))
        return detections.select("track_id", "frame_id", line.alias("line"))
    if kind == "csv":
        if trajectories is not None:
            return trajectories.select("global_id", F.concat_ws(",", "global_id", "num_cameras", "total_duration", "confidence").alias("line"))
        return stats.select("track_id", "camera_id", F.concat_ws(",", "track_id", "camera_id", "numFrames", "startFrame", "endFrame").alias("line"))
    if kind == "json":
        source = trajectories if trajectories is not None else stats
        return source.select(F.to_json(F.struct(*source.columns)).alias("line"))
    raise ValueError(f"unknown kind of export {kind}: one of json, csv, mot")


def write_ablation(table: DataFrame, path: str) -> None:
    """The table of variants as CSV with a header."""
    table.write.option("header", True).csv(path)


def ground_track_rows(points: DataFrame) -> DataFrame:
    """(track_id, frame_id, raw_frame_id, x_world_cm, y_world_cm, score) as text with three and four decimals."""
    three = [F.format_string("%.3f", c).alias(n) for c, n in (("x", "x_world_cm"), ("y", "y_world_cm"))]
    raw = F.coalesce("raw_frame_id", "frame_id").alias("raw_frame_id")
    return points.select("track_id", "frame_id", raw, *three, F.format_string("%.4f", "score").alias("score"))


def ground_track_objects(points: DataFrame) -> DataFrame:
    """(track_id, mean_confidence, detections): a row for each track, its points by frame."""
    step = F.struct("frame_id", F.coalesce("raw_frame_id", "frame_id").alias("raw_frame_id"), F.col("x").alias("x_world_cm"), F.col("y").alias("y_world_cm"), "score")
    return points.groupBy("track_id").agg(F.avg("score").alias("mean_confidence"), F.array_sort(F.collect_list(step)).alias("detections"))


def write_ground_tracks(points: DataFrame, path: str) -> None:
    """Tracks as JSON lines in path/json and as CSV in path/csv."""
    ground_track_objects(points).write.json(f"{path}/json")
    ground_track_rows(points).sortWithinPartitions("track_id", "frame_id").write.option("header", True).csv(f"{path}/csv")


def packed_matrix(rows: DataFrame, order: str = "position") -> DataFrame:
    """(file, content): rows (file, position, v) of each file as one .npy matrix, ready to be stored as it is. A
    file is put together by one task; give large tables several files."""
    import numpy as np
    import pandas as pd

    def run(part: pd.DataFrame) -> pd.DataFrame:
        import io

        held = io.BytesIO()
        np.save(held, np.stack(part.sort_values(order)["v"].to_numpy()))
        return pd.DataFrame({"file": part["file"].iloc[:1], "content": [held.getvalue()]})

    return rows.groupBy("file").applyInPandas(run, "file string, content binary")


def newest_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Each key's newest row."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
