"""Streams of detections: tracklets as sessions, and an append-only correction log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.components import components


def session_tracklets(events: DataFrame, gap: str, watermark: str | None = None) -> DataFrame:
    """(user_id, start, end, n, total) of runs of (user_id, ts, value) with pauses of at most `gap`; as a
    stream, runs close after the watermark."""
    timed = events.withWatermark("ts", watermark) if watermark else events
    grouped = timed.groupBy("user_id", F.session_window("ts", gap).alias("s"))
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "total")


def active_corrections(log: DataFrame, log_id: str = "log_id") -> DataFrame:
    """Logs (log_id, id, action, source_gid, target_gid) without undone rows: each row of action undo undoes
    the newest row before it in its log that wasn't undone; with none left it does nothing. Undos cancel
    like brackets, so a row stays if the depth after it never falls below its own."""
    w = Window.partitionBy(log_id).orderBy("id")
    step = F.when(F.col("action") == "undo", -1).otherwise(1)
    depth = log.withColumn("depth", F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    later = depth.withColumn("lowest", F.min("depth").over(w.rowsBetween(1, Window.unboundedFollowing)))
    return later.where((F.col("action") != "undo") & (F.col("lowest").isNull() | (F.col("lowest") >= F.col("depth")))).drop("depth", "lowest")


def relabelled(assignment: DataFrame, moves: DataFrame) -> DataFrame:
    """(tracklet columns, global_id) after moves (source_gid, target_gid); the newest move of a source
    counts."""
    latest = moves.groupBy("source_gid").agg(F.max_by("target_gid", "id").alias("target_gid"))
    joined = assignment.join(latest, assignment["global_id"] == latest["source_gid"], "left")
    return joined.withColumn("global_id", F.coalesce("target_gid", "global_id")).drop("source_gid", "target_gid")


def merged_ids(assignment: DataFrame, merges: DataFrame) -> DataFrame:
    """(tracklet columns, global_id) after merges (source_gid, target_gid): identities that are tied, directly
    or through others, take the smallest id."""
    found = components(merges.select(F.col("source_gid").alias("a"), F.col("target_gid").alias("b")))
    joined = assignment.join(found, assignment["global_id"] == found["node"], "left")
    return joined.withColumn("global_id", F.coalesce("component", "global_id")).drop("node", "component")
