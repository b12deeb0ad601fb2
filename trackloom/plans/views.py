"""Stand-in views: tracking tables derived from the given ones by fixed rules, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators.simjoin import similar_pairs

FEATURES = """feat AS (SELECT vec_id AS index_id, 'S0' || (1 + label % 2) || '_c00' || (1 + label % 5) AS camera_id,
 vec_id % 3 AS class_id, vec_id % 50 AS pid, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"""

DETECTIONS = """det AS (SELECT event_id, 'c00' || (event_id % 4) AS camera_id, user_id AS track_id,
 epoch_us(ts) // 3600000000 AS frame_id, least(value / 500, 1.0) AS confidence, event_id % 3 AS class_id,
 (event_id % 400)::DOUBLE AS x, ((event_id * 7) % 300)::DOUBLE AS y, (40 + event_id % 60)::DOUBLE AS w,
 (30 + event_id % 50)::DOUBLE AS h FROM events)"""

#: Detections whose tracks are cut at midnight, so that tracklets follow each other in time.
CHOPPED = DETECTIONS.replace("user_id AS track_id", "user_id * 1000 + (epoch_us(ts) // 86400000000) % 1000 AS track_id")

_STATS = """, stats AS (SELECT camera_id, track_id, min(frame_id) AS start_frame, max(frame_id) AS end_frame,
 count(*) AS num_frames, avg(confidence) AS mean_confidence FROM det GROUP BY ALL)"""
CHOPPED_STATS = CHOPPED + _STATS
STATS = DETECTIONS + _STATS

#: Pairs of one class and scene from two cameras, with 0.25 as threshold.
PAIRS = FEATURES + """, pairs AS (SELECT a.index_id AS i, b.index_id AS j, list_inner_product(a.v, b.v) AS sim,
 a.camera_id AS camera_i, b.camera_id AS camera_j, a.class_id AS class_id, a.pid AS pid_i, b.pid AS pid_j
 FROM feat a JOIN feat b ON a.class_id = b.class_id AND a.camera_id < b.camera_id AND left(a.camera_id, 3) = left(b.camera_id, 3)),
 edges AS (SELECT * FROM pairs WHERE sim >= 0.25)"""

#: Scored pairs: start and end of a feature are hours derived from its id.
SCORED = PAIRS + """, timed AS (SELECT *, (i % 24)::DOUBLE AS start_i, (i % 24 + 1 + i % 5)::DOUBLE AS end_i,
 (j % 24)::DOUBLE AS start_j, (j % 24 + 1 + j % 5)::DOUBLE AS end_j, (5 + i % 30) AS frames_i, (5 + j % 30) AS frames_j,
 (i % 10) / 10.0::DOUBLE AS hsv_sim FROM edges)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    camera = F.concat(F.lit("S0"), 1 + F.col("label") % 2, F.lit("_c00"), 1 + F.col("label") % 5)
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("index_id"), camera.alias("camera_id"), (F.col("vec_id") % 3).alias("class_id"),
        (F.col("vec_id") % 50).alias("pid"), F.col("embedding").cast("array<double>").alias("v"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("c00"), e % 4).alias("camera_id"), F.col("user_id").alias("track_id"),
        F.expr("unix_micros(cast(ts AS timestamp)) div 3600000000").alias("frame_id"),
        F.least(F.col("value") / 500, F.lit(1.0)).alias("confidence"), (e % 3).alias("class_id"),
        (e % 400).cast("double").alias("x"), ((e * 7) % 300).cast("double").alias("y"),
        (40 + e % 60).cast("double").alias("w"), (30 + e % 50).cast("double").alias("h"),
    )


def edges(spark: SparkSession, sf_dir: str, min_similarity: float = 0.25) -> DataFrame:
    """Similar pairs with cameras, class and person of both ends."""
    found = similar_pairs(features(spark, sf_dir), min_similarity, "camera_id", "class_id", "pid")
    return found.select("j", "i", "sim", F.col("camera_id_i").alias("camera_i"), F.col("class_id_i").alias("class_id"), "pid_i", F.col("camera_id_j").alias("camera_j"), "pid_j")


def timed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def span(c: str, k: str):
        return {f"start_{k}": (F.col(c) % 24).cast("double"), f"end_{k}": (F.col(c) % 24 + 1 + F.col(c) % 5).cast("double"), f"frames_{k}": 5 + F.col(c) % 30}

    return edges(spark, sf_dir).withColumns(span("i", "i") | span("j", "j") | {"hsv_sim": (F.col("i") % 10) / F.lit(10.0)})


def chopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections whose tracks are cut at midnight."""
    return detections(spark, sf_dir).withColumn("track_id", F.col("track_id") * 1000 + F.expr("frame_id div 24") % 1000)
