"""Scores of tracklet pairs (i, j, sim, camera_i, camera_j, start_i, end_i, start_j, end_j, ...)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.components import components
from trackloom.tables import written


def temporal_overlap(start_i, end_i, start_j, end_j) -> Column:
    """Common time over the shorter duration, in [0, 1]; 0 where there is none."""
    common = F.least(end_i, end_j) - F.greatest(start_i, start_j)
    shorter = F.least(end_i - start_i, end_j - start_j)
    return F.when((common > 0) & (shorter > 0), F.least(common / shorter, F.lit(1.0))).otherwise(0.0)


def with_priors(pairs: DataFrame, priors: DataFrame) -> DataFrame:
    """Pairs with the prior (min_time, max_time, mean_time, std_time) of their cameras in either order;
    the given order wins. Whether a camera is in the table at all is added as listed_a, listed_b."""
    columns = ["min_time", "max_time", "mean_time", "std_time"]
    ahead = priors.select(F.col("cam_a").alias("first_camera"), F.col("cam_b").alias("second_camera"), *[F.col(c).alias(f"f_{c}") for c in columns])
    back = priors.select(F.col("cam_b").alias("first_camera"), F.col("cam_a").alias("second_camera"), *[F.col(c).alias(f"b_{c}") for c in columns])
    listed = priors.select(F.col("cam_a").alias("camera")).distinct()
    out = pairs.join(ahead, ["first_camera", "second_camera"], "left").join(back, ["first_camera", "second_camera"], "left")
    for side, camera in (("listed_a", "first_camera"), ("listed_b", "second_camera")):
        out = out.join(listed.select(F.col("camera").alias(camera), F.lit(True).alias(side)), camera, "left").withColumn(side, F.coalesce(side, F.lit(False)))
    from_ahead = F.col("f_min_time").isNotNull()
    picked = {c: F.when(from_ahead, F.col(f"f_{c}")).otherwise(F.col(f"b_{c}")) for c in columns}
    return out.withColumns(picked).drop(*[f"{s}_{c}" for s in "fb" for c in columns])


def prior_score(gap: Column, low, high, mean, std) -> Column:
    """Gaussian around the mean, as wide as the deviation or a third of the range; 0 out of the range."""
    sigma = F.when(F.coalesce(std, F.lit(0.0)) > 0, F.greatest(std, (high - low) / 3)).otherwise(F.greatest((high - low) / 3, F.lit(1.0)))
    centre = F.coalesce(mean, (low + high) / 2)
    return F.when(gap.between(low, high), F.exp(-0.5 * F.pow((gap - centre) / sigma, 2))).otherwise(0.0)


def global_score(gap: Column, low: float, high: float) -> Column:
    """Half Gaussian from the least gap, 0.01 at the largest; 0 out of the range."""
    sigma = max((high - low) / math.sqrt(2 * math.log(100)), 1.0)
    return F.when(gap.between(low, high), F.exp(-0.5 * F.pow((gap - low) / sigma, 2))).otherwise(0.0)


def transition_score(gap: Column, low: float, high: float) -> Column:
    """Score of pairs with priors: by the prior if there is one, 0 where a listed camera has none for
    the other, else by the global range."""
    by_prior = prior_score(gap, F.col("min_time"), F.col("max_time"), F.col("mean_time"), F.col("std_time"))
    blocked = F.col("listed_a") | F.col("listed_b")
    return F.when(F.col("min_time").isNotNull(), by_prior).when(blocked, 0.0).otherwise(global_score(gap, low, high))


@dataclass(frozen=True)
class Weights:
    """Weights of the combined score; persons are classes in `persons`."""

    person: tuple[float, float, float] = (0.65, 0.10, 0.25)
    vehicle: tuple[float, float, float] = (0.50, 0.25, 0.25)
    persons: tuple[int, ...] = (0,)
    length_power: float = 0.0
    overlap_bonus: float = 0.0
    overlap_max_mean: float = 5.0


def combined_score(pairs: DataFrame, weights: Weights, low: float, high: float) -> DataFrame:
    """Pairs with priors and `score`: appearance, colour (hsv_sim) and transition by class, a bonus for
    time in common, and a factor for short tracklets. Pairs without a possible transition go."""
    gap = F.greatest(F.lit(0.0), F.greatest("start_i", "start_j") - F.least("end_i", "end_j"))
    scored = pairs.withColumn("st", transition_score(gap, low, high)).where("st > 0")
    person = F.col("class_id").isin(*weights.persons)
    w = [F.when(person, a).otherwise(b) for a, b in zip(weights.person, weights.vehicle, strict=True)]
    score = w[0] * F.col("sim") + w[1] * F.col("hsv_sim") + w[2] * F.col("st")
    if weights.overlap_bonus:
        overlap = temporal_overlap(F.col("start_i"), F.col("end_i"), F.col("start_j"), F.col("end_j"))
        near = F.when(F.col("min_time").isNotNull(), F.coalesce(F.col("mean_time") <= weights.overlap_max_mean, F.lit(False))).otherwise(low == 0)
        score = score + F.when(near & (F.col("camera_i") != F.col("camera_j")), weights.overlap_bonus * overlap).otherwise(0.0)
    if weights.length_power:
        shorter = F.greatest(F.least("frames_i", "frames_j"), F.lit(1))
        score = score * (0.5 + 0.5 * F.pow(shorter / (shorter + 10.0), F.lit(weights.length_power)))
    return scored.withColumn("score", score)


def ordered_cameras(pairs: DataFrame) -> DataFrame:
    """Adds first_camera and second_camera: the camera of the earlier start comes first."""
    first = F.col("start_i") <= F.col("start_j")
    return pairs.withColumns(
        {
            "first_camera": F.when(first, F.col("camera_i")).otherwise(F.col("camera_j")),
            "second_camera": F.when(first, F.col("camera_j")).otherwise(F.col("camera_i")),
        }
    )


def recentred(pairs: DataFrame, min_pairs: int) -> DataFrame:
    """Scores shifted so that camera pairs with enough rows share the mean of their means."""
    cams = [F.least("camera_i", "camera_j").alias("cam_a"), F.greatest("camera_i", "camera_j").alias("cam_b")]
    keyed = pairs.withColumns({"cam_a": cams[0], "cam_b": cams[1]})
    means = keyed.groupBy("cam_a", "cam_b").agg(F.avg("score").alias("mean"), F.count("*").alias("n")).where(F.col("n") >= min_pairs)
    whole = means.agg(F.avg("mean").alias("whole")).first()["whole"]
    return keyed.join(means, ["cam_a", "cam_b"], "left").withColumn("score", F.col("score") + F.coalesce(F.lit(whole) - F.col("mean"), F.lit(0.0))).drop("mean", "n")


def learned_priors(links: DataFrame) -> DataFrame:
    """Transition priors of (cam_a, cam_b, gap): min * 0.8, max * 1.2, mean, sample deviation (a quarter
    of the range for one row, at least 1)."""
    spread = F.coalesce(F.stddev_samp("gap"), (F.max("gap") - F.min("gap")) / 4)
    return links.groupBy("cam_a", "cam_b").agg(
        (F.min("gap") * 0.8).alias("min_time"), (F.max("gap") * 1.2).alias("max_time"), F.avg("gap").alias("mean_time"),
        F.greatest(spread, F.lit(1.0)).alias("std_time"), F.count("*").alias("n"),
    )


def camera_bias(linked: DataFrame, min_rows: int = 3) -> DataFrame:
    """(cam_a, cam_b, bias): the median of scores (camera_i, camera_j, score) of linked pairs."""
    keyed = linked.withColumns({"cam_a": F.least("camera_i", "camera_j"), "cam_b": F.greatest("camera_i", "camera_j")})
    return keyed.groupBy("cam_a", "cam_b").agg(F.median("score").alias("bias"), F.count("*").alias("n")).where(F.col("n") >= min_rows).drop("n")


def bias_adjusted(pairs: DataFrame, bias: DataFrame) -> DataFrame:
    """Scores moved by how far their camera pair's bias is from the mean bias, within 0..1."""
    whole = bias.agg(F.avg("bias").alias("m")).first()["m"]
    keyed = pairs.withColumns({"cam_a": F.least("camera_i", "camera_j"), "cam_b": F.greatest("camera_i", "camera_j")})
    shift = F.when(F.col("bias") > 0, F.lit(whole) - F.col("bias"))
    moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") + shift))
    return keyed.join(bias, ["cam_a", "cam_b"], "left").withColumn("score", F.coalesce(moved, F.col("score"))).drop("bias")


def over_threshold(pairs: DataFrame, by_cameras: DataFrame, default: float) -> DataFrame:
    """Pairs that reach the threshold (cam_a, cam_b, threshold) of their cameras, else the default."""
    keyed = pairs.withColumns({"cam_a": F.least("camera_i", "camera_j"), "cam_b": F.greatest("camera_i", "camera_j")})
    return keyed.join(by_cameras, ["cam_a", "cam_b"], "left").where(F.col("score") >= F.coalesce("threshold", F.lit(default))).drop("threshold")


def boosted(pairs: DataFrame, boosts: DataFrame) -> DataFrame:
    """Scores plus the boost (i, j, boost) of the pair in either order."""
    both = boosts.unionByName(boosts.select(F.col("j").alias("i"), F.col("i").alias("j"), "boost")).groupBy("i", "j").agg(F.max("boost").alias("boost"))
    return pairs.join(both, ["i", "j"], "left").withColumn("score", F.col("score") + F.coalesce("boost", F.lit(0.0))).drop("boost")


def nearest_zone(points: DataFrame, zones: DataFrame) -> DataFrame:
    """(point columns, zone): the zone of the camera whose centre (cx, cy) is nearest; lowest on ties."""
    near = points.join(zones, "camera_id").withColumn("d", F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")))
    keys = points.columns
    return near.groupBy(*keys).agg(F.min_by("zone", F.struct("d", "zone")).alias("zone"))


def zone_adjusted(pairs: DataFrame, seen: DataFrame, bonus: float, penalty: float) -> DataFrame:
    """Scores plus a bonus where the zones (zone_i, zone_j) were seen to follow each other in either
    direction (seen: zone_a, zone_b), less a penalty where both zones are known but weren't."""
    both = seen.unionByName(seen.select(F.col("zone_b").alias("zone_a"), F.col("zone_a").alias("zone_b"))).distinct()
    joined = pairs.join(both.select(F.col("zone_a").alias("zone_i"), F.col("zone_b").alias("zone_j"), F.lit(True).alias("seen")), ["zone_i", "zone_j"], "left")
    known = F.col("zone_i").isNotNull() & F.col("zone_j").isNotNull()
    return joined.withColumn("score", F.col("score") + F.when(F.col("seen"), bonus).when(known, -penalty).otherwise(0.0)).drop("seen")


def merged_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """(i, j, sim): both tables' edges, the larger similarity where both have one."""
    return edges.select("i", "j", "sim").unionByName(more.select("i", "j", "sim")).groupBy("i", "j").agg(F.max("sim").alias("sim"))


def alert_level(similarity: Column, confidence: Column) -> Column:
    score = F.round(similarity * confidence, 9)  # a mean at the limit isn't moved below it by the order of its sum
    return F.when(score >= 0.60, "HIGH").when(score >= 0.40, "MEDIUM").otherwise("LOW")


def iterated_bias(pairs: DataFrame, threshold: float, rounds: int, min_rows: int = 3) -> DataFrame:
    """Pairs (i, j, score, camera_i, camera_j) after rounds of clustering from the threshold on, learning each pair
    of cameras' bias from pairs inside clusters, and adjusting all scores by it."""
    now = pairs
    for _ in range(rounds):
        kept = now.where(F.col("score") >= threshold)
        found = components(kept.select(F.col("i").alias("a"), F.col("j").alias("b")))
        a, b = found.toDF("i", "part"), found.toDF("j", "other")
        inside = now.join(a, "i").join(b, "j").where("part = other").drop("part", "other")
        now = written(bias_adjusted(now, camera_bias(inside, min_rows)).select(*pairs.columns))
    return now
