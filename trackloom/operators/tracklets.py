"""Tracklet algebra over detection rows (camera_id, track_id, frame_id, x, y, w, h, confidence, class_id)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.geometry import iou_xywh

KEY = ["camera_id", "track_id"]
#: The order of a tracklet's rows; event_id breaks ties.
ORDER = ["frame_id", "event_id"]


def place() -> Column:
    return F.struct(*ORDER)


def with_corners(rows: DataFrame) -> DataFrame:
    """Adds x1, y1, x2, y2 to xywh rows."""
    return rows.withColumns({"x1": F.col("x"), "y1": F.col("y"), "x2": F.col("x") + F.col("w"), "y2": F.col("y") + F.col("h")})


def tracklet_stats(rows: DataFrame, fps: float = 1.0) -> DataFrame:
    """Start, end, duration, number of frames and mean confidence of each tracklet."""
    return (
        rows.groupBy(*KEY)
        .agg(F.min("frame_id").alias("start_frame"), F.max("frame_id").alias("end_frame"), F.count("*").alias("num_frames"), F.avg("confidence").alias("mean_confidence"))
        .withColumn("duration", (F.col("end_frame") - F.col("start_frame")) / F.lit(fps))
    )


def majority_class(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The most frequent class of each key, the smallest on ties."""
    counts = rows.groupBy(*(keys or KEY), "class_id").agg(F.count("*").alias("n"))
    return counts.groupBy(*(keys or KEY)).agg(F.max_by("class_id", F.struct("n", (-F.col("class_id")).alias("c"))).alias("class_id"), F.max("n").alias("n_rows"))


def long_tracklets(rows: DataFrame, min_frames: int, min_area: float) -> DataFrame:
    """Tracklets with enough frames and a large enough mean box."""
    stats = rows.groupBy(*KEY).agg(F.count("*").alias("num_frames"), F.avg(F.col("w") * F.col("h")).alias("mean_area"))
    return stats.where((F.col("num_frames") >= min_frames) & (F.col("mean_area") >= min_area))


def finite_detections(rows: DataFrame) -> DataFrame:
    """Rows with finite, well-formed boxes."""
    ok = F.lit(True)
    for c in ("x", "y", "w", "h", "confidence"):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return rows.where(ok & (F.col("w") > 0) & (F.col("h") > 0))


def drop_reasons(stats: DataFrame, min_frames: int, min_confidence: float) -> DataFrame:
    """Each tracklet's reason to be dropped: both, length, confidence, missing, or null if kept. Means are
    compared to nine digits, so that one at the limit isn't moved below it by the order of its sum."""
    short, weak = F.col("num_frames") < min_frames, F.round("mean_confidence", 9) < min_confidence
    return stats.withColumn(
        "reason",
        F.when(F.col("num_frames").isNull(), "missing").when(short & weak, "both").when(short, "length").when(weak, "confidence"),
    )


def overlapping(stats: DataFrame, start: float, end: float) -> DataFrame:
    """Tracklets whose time span meets [start, end]."""
    return stats.where((F.col("end_frame") >= start) & (F.col("start_frame") <= end))


def best_per_frame(rows: DataFrame, frame: str = "frame_id") -> DataFrame:
    """One row for each (camera, frame, track): the most confident, the earliest on ties."""
    w = Window.partitionBy("camera_id", frame, "track_id").orderBy(F.desc("confidence"), "event_id")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def top_per_frame(rows: DataFrame, k: int, frame: str = "frame_id") -> DataFrame:
    """The k most confident rows of each (camera, frame)."""
    w = Window.partitionBy("camera_id", frame).orderBy(F.desc("confidence"), "event_id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def filled_gaps(rows: DataFrame, max_gap: int) -> DataFrame:
    """Rows and interpolated ones: gaps of 2..max_gap frames get linear boxes of confidence 0. One row
    for each frame of a tracklet is expected."""
    w = Window.partitionBy(*KEY).orderBy(*ORDER)
    boxes = ("x", "y", "w", "h")
    ahead = rows.select(*KEY, "frame_id", *boxes, "confidence", F.lead("frame_id").over(w).alias("to"), *[F.lead(c).over(w).alias(f"{c}_to") for c in boxes])
    gap = ahead.where((F.col("to") - F.col("frame_id") > 1) & (F.col("to") - F.col("frame_id") <= max_gap))
    steps = gap.withColumn("at", F.explode(F.sequence(F.col("frame_id") + 1, F.col("to") - 1)))
    share = (F.col("at") - F.col("frame_id")) / (F.col("to") - F.col("frame_id"))
    lerp = [(F.col(c) + (F.col(f"{c}_to") - F.col(c)) * share).alias(c) for c in boxes]
    made = steps.select(*KEY, F.col("at").alias("frame_id"), *lerp, F.lit(0.0).alias("confidence"))
    return rows.select(*KEY, "frame_id", *boxes, "confidence").unionByName(made)


def trimmed_by_confidence(rows: DataFrame, min_frames: int = 5) -> DataFrame:
    """Tracklets without the leading and trailing rows below their upper median confidence; short ones
    are left alone."""
    size = F.count("*").over(Window.partitionBy(*KEY))
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy("confidence", "frame_id"))
    ranked = rows.withColumns({"n": size, "r": rank})
    whole = Window.partitionBy(*KEY)
    ranked = ranked.withColumn("median", F.max(F.when(F.col("r") == F.floor(F.col("n") / 2) + 1, F.col("confidence"))).over(whole))
    high = F.when(F.col("confidence") >= F.col("median"), F.col("frame_id"))
    ranked = ranked.withColumns({"low": F.min(high).over(whole), "top": F.max(high).over(whole)})
    return ranked.where((F.col("n") < min_frames) | F.col("frame_id").between(F.col("low"), F.col("top"))).drop("n", "r", "median", "low", "top")


def trimmed_by_share(rows: DataFrame, share: float) -> DataFrame:
    """Tracklets without floor(share * n) rows at each end."""
    w = Window.partitionBy(*KEY)
    ranked = rows.withColumns({"n": F.count("*").over(w), "r": F.row_number().over(w.orderBy(*ORDER))})
    cut = F.floor(F.col("n") * share)
    return ranked.where((F.col("r") > cut) & (F.col("r") <= F.col("n") - cut)).drop("n", "r")


def entry_exit(rows: DataFrame) -> DataFrame:
    """Centres of each tracklet's first and last box."""
    centre = F.struct((F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"))
    ends = rows.groupBy(*KEY).agg(F.min_by(centre, place()).alias("a"), F.max_by(centre, place()).alias("b"))
    return ends.select(*KEY, F.col("a.cx").alias("entry_x"), F.col("a.cy").alias("entry_y"), F.col("b.cx").alias("exit_x"), F.col("b.cy").alias("exit_y"))


def moving_tracks(rows: DataFrame, min_shift: float, min_speed: float | None = None) -> DataFrame:
    """(track_id) of trajectories with any tracklet whose ends are at least min_shift apart and, from
    three rows on, whose mean step speed is at least min_speed. Tracklets of one row never count."""
    w = Window.partitionBy(*KEY).orderBy(*ORDER)
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    steps = rows.withColumns({"cx": cx, "cy": cy})
    steps = steps.withColumns({"px": F.lag("cx").over(w), "py": F.lag("cy").over(w), "pf": F.lag("frame_id").over(w)})
    speed = F.hypot(F.col("cx") - F.col("px"), F.col("cy") - F.col("py")) / F.greatest(F.col("frame_id") - F.col("pf"), F.lit(1))
    ends = steps.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.avg(speed).alias("speed"),
        F.min_by("cx", place()).alias("ax"), F.min_by("cy", place()).alias("ay"), F.max_by("cx", place()).alias("bx"), F.max_by("cy", place()).alias("by"),
    )
    moves = (F.col("n") > 1) & (F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) >= min_shift)
    if min_speed is not None:
        moves = moves & ((F.col("n") < 3) | (F.col("speed") >= min_speed))
    return ends.groupBy("track_id").agg(F.bool_or(moves).alias("moves")).where("moves").select("track_id")


def largest_silence(stats: DataFrame, keys: list[str]) -> DataFrame:
    """The longest gap between the end of all earlier spans and the next start."""
    w = Window.partitionBy(*keys).orderBy("start_frame", "end_frame").rowsBetween(Window.unboundedPreceding, -1)
    gap = F.col("start_frame") - F.max("end_frame").over(w)
    return stats.withColumn("gap", F.greatest(F.lit(0), gap)).groupBy(*keys).agg(F.coalesce(F.max("gap"), F.lit(0)).alias("largest_gap"))


def sampled_frames(rows: DataFrame, n: int = 6) -> DataFrame:
    """The middle frame, and n evenly spaced rows by half-even rounding of their places."""
    w = Window.partitionBy(*KEY)
    ranked = rows.withColumns({"n_rows": F.count("*").over(w), "at": F.row_number().over(w.orderBy(*ORDER)) - 1})
    step = (F.col("n_rows") - 1) / F.lit(n - 1)
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.bround(k * step).cast("int"))
    return ranked.withColumns({"is_middle": F.col("at") == F.floor(F.col("n_rows") / 2), "is_sample": F.array_contains(F.array_distinct(places), F.col("at"))})


def endpoint_velocity(rows: DataFrame, window: int = 3) -> DataFrame:
    """Mean velocity over the first and the last max(2, window) rows of each tracklet."""
    k = max(2, window)
    up, down = Window.partitionBy(*KEY).orderBy(*ORDER), Window.partitionBy(*KEY).orderBy(*[F.desc(c) for c in ORDER])
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    ranked = rows.withColumns({"cx": cx, "cy": cy, "a": F.row_number().over(up), "b": F.row_number().over(down)})

    def side(rank: str, name: str) -> list[Column]:
        near = F.col(rank) <= k
        inside, by = F.when(near, F.col("frame_id")), F.when(near, place())
        span = F.max(inside) - F.min(inside)
        return [((F.max_by(c, by) - F.min_by(c, by)) / F.nullif(span, F.lit(0))).alias(f"{name}_v{c[1]}") for c in ("cx", "cy")]

    return ranked.groupBy(*KEY).agg(*side("a", "start"), *side("b", "end"))


def suppressed(rows: DataFrame, max_iou: float, frame: str = "frame_id") -> DataFrame:
    """Greedy non-maximum suppression in each (camera, frame): from the most confident on, a box goes
    if it overlaps a kept box by more than max_iou. A frame's boxes are one group."""
    box = F.struct((-F.col("confidence")).alias("order"), "event_id", "track_id", "x", "y", "w", "h", "confidence")
    frames = rows.groupBy("camera_id", frame).agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    def overlaps(a: Column, b: Column) -> Column:
        return iou_xywh(a["x"], a["y"], a["w"], a["h"], b["x"], b["y"], b["w"], b["h"]) > max_iou

    kept = F.aggregate(
        "boxes",
        F.slice("boxes", 1, 0),
        lambda held, b: F.when(F.exists(held, lambda a: overlaps(a, b)), held).otherwise(F.concat(held, F.array(b))),
    )
    return frames.select("camera_id", frame, F.inline(kept)).drop("order")


#: Tracks of a block whose shared frames one task counts against another block's: a table of 4 million pairs.
TRACK_BLOCK = 2048
#: Frames that are multiplied at once, and pairs that are counted at once where frames have few tracks.
FRAME_STEP, PAIR_STEP = 1024, 1 << 22


def _common(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """How many frames each two tracks have in common; a, b: places of tracks and their frames, each once."""
    frames = np.intersect1d(a[1], b[1])
    (ra, fa), (rb, fb) = ((r[k], np.searchsorted(frames, f[k])) for r, f, k in ((*x, np.isin(x[1], frames)) for x in (a, b)))
    counts = np.zeros(shape, dtype=np.float32)  # whole numbers, exact below 2**24
    order_a, order_b = np.argsort(fa, kind="stable"), np.argsort(fb, kind="stable")
    ra, fa, rb, fb = ra[order_a], fa[order_a], rb[order_b], fb[order_b]
    starts, sizes = np.searchsorted(fb, fa), np.bincount(fb, minlength=len(frames))[fa]
    if sizes.sum() * 64 < len(frames) * shape[0] * shape[1]:
        ends, k = np.cumsum(sizes), 0
        while k < len(fa):
            upto = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIR_STEP)))
            own = sizes[k:upto]
            inner = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            np.add.at(counts, (np.repeat(ra[k:upto], own), rb[np.repeat(starts[k:upto], own) + inner]), 1)
            k = upto
        return counts
    for k in range(0, len(frames), FRAME_STEP):
        sides = []
        for (r, f), n in zip(((ra, fa), (rb, fb)), shape, strict=True):
            s = slice(*np.searchsorted(f, [k, k + FRAME_STEP]))
            side = np.zeros((n, FRAME_STEP), dtype=np.float32)
            side[r[s], f[s] - k] = 1
            sides.append(side)
        counts += sides[0] @ sides[1].T
    return counts


def shared_frames(rows: DataFrame, least: int) -> DataFrame:
    """(pred, gt, cameras): tracks pred < gt that share at least `least` frames in one camera or several, and in how many.
    Tracks are dealt into blocks, and tasks count two blocks against each other in all cameras, so that a track's frames
    travel once for each block and no pair is shuffled."""
    tracks = rows.where("camera_id is not null and frame_id is not null and track_id is not null").groupBy("track_id", "camera_id").agg(F.collect_set("frame_id").alias("frames"))
    tracks = tracks.where(F.size("frames") >= least)
    blocks = tracks.agg(F.ceil(F.count_distinct("track_id") / TRACK_BLOCK).cast("int").alias("blocks"))
    dealt = tracks.crossJoin(F.broadcast(blocks)).withColumn("own", F.pmod(F.xxhash64("track_id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "track_id", "camera_id", "frames")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        names = [np.unique(part.loc[part["own"] == part[k].iloc[0], "track_id"]) for k in "ij"]
        cameras = np.zeros((len(names[0]), len(names[1])), dtype=np.int32)
        for _, seen in part.groupby("camera_id"):
            sides = []
            for k, ids in zip("ij", names, strict=True):
                side = seen[seen["own"] == seen[k].iloc[0]]
                at = np.searchsorted(ids, side["track_id"].to_numpy())
                sides.append((np.repeat(at, side["frames"].map(len)), np.concatenate([np.empty(0, dtype=np.int64), *side["frames"]])))
            cameras += _common(*sides, cameras.shape) >= least
        if part["i"].iloc[0] == part["j"].iloc[0]:
            cameras = np.triu(cameras, 1)
        a, b = np.nonzero(cameras)
        x, y = names[0][a], names[1][b]
        return pd.DataFrame({"pred": np.minimum(x, y), "gt": np.maximum(x, y), "cameras": cameras[a, b].astype("int64")})

    return dealt.groupBy("i", "j").applyInPandas(run, "pred long, gt long, cameras long")
