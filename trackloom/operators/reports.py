"""Lookups and reports over tracklets, clusters, runs and evaluation results."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.geometry import to_image
from trackloom.functions.vectors import dot
from trackloom.operators.components import components
from trackloom.operators.tracklets import KEY, ORDER, majority_class, place, tracklet_stats
from trackloom.operators.vectors import summed


def detection_listing(rows: DataFrame, camera: str, frame: int | None = None) -> DataFrame:
    """Detections of a camera at a frame; without a frame, each track's first one."""
    own = rows.where(F.col("camera_id") == camera)
    if frame is not None:
        return own.where(F.col("frame_id") == frame)
    w = Window.partitionBy(*KEY).orderBy(*ORDER)
    return own.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def tracklet_listing(rows: DataFrame) -> DataFrame:
    """Statistics of each tracklet with its class and its middle box."""
    w = Window.partitionBy(*KEY)
    middle = rows.withColumns({"n": F.count("*").over(w), "at": F.row_number().over(w.orderBy(*ORDER)) - 1}).where(F.col("at") == F.floor(F.col("n") / 2))
    box = middle.select(*KEY, F.col("frame_id").alias("middle_frame"), "x", "y", "w", "h")
    return tracklet_stats(rows).join(majority_class(rows).select(*KEY, "class_id"), KEY).join(box, KEY)


def cleaned_timelines(trajectories: DataFrame) -> DataFrame:
    """Trajectories (global_id, timeline array<struct<camera_id, track_id, ...>>) without steps of cameras named
    query_..., each (camera, track) once, in place."""
    others = [c for c in trajectories.columns if c != "timeline"]
    own = [*others, F.col("timeline").isNull().alias("__none")]
    real = F.filter("timeline", lambda t: ~t["camera_id"].startswith("query_"))
    # Steps meet by name in a shuffle: looking for each one in its own array takes the square of its length.
    steps = trajectories.select(*own, F.posexplode_outer(real).alias("__place", "__step"))
    name = F.concat_ws("/", "__step.camera_id", "__step.track_id").alias("__name")
    first = steps.groupBy(*others, "__none", name).agg(F.min(F.struct("__place", "__step")).alias("__first"))
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("__first.__place").isNotNull(), F.col("__first")))), lambda s: s["__step"])
    whole = first.groupBy(*others, "__none").agg(kept.alias("timeline"))
    return whole.withColumn("timeline", F.when(~F.col("__none"), F.col("timeline"))).select(*trajectories.columns)


def evidence_pairs(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster, i, j, similarity, place): scored pairs inside each cluster, the strongest first."""
    a, b = members.toDF("i", "cluster"), members.toDF("j", "cluster_j")
    inside = edges.join(a, "i").join(b, "j").where("cluster = cluster_j").withColumn("similarity", F.round("sim", 4))
    w = Window.partitionBy("cluster").orderBy(F.desc("similarity"), "i", "j")
    return inside.select("cluster", "i", "j", "similarity", F.row_number().over(w).alias("place"))


def confident_if_multi_camera(trajectories: DataFrame, min_confidence: float) -> DataFrame:
    """Trajectories of several cameras need the confidence; those of one camera pass."""
    return trajectories.where((F.col("num_cameras") < 2) | (F.col("confidence") >= min_confidence))


def with_metadata(features: DataFrame, metadata: DataFrame) -> DataFrame:
    """Features with the span and number of frames of (index_id, start, end, num_frames); a span the wrong
    way round is turned, and a feature without metadata gets 0, 0 and 1."""
    facts = metadata.select("index_id", F.least("start", "end").alias("start"), F.greatest("start", "end").alias("end"), "num_frames")
    joined = features.join(facts, "index_id", "left")
    return joined.fillna({"start": 0.0, "end": 0.0, "num_frames": 1})


def with_trajectories(hits: DataFrame, members: DataFrame, spans: DataFrame) -> DataFrame:
    """Hits (index_id, ...) with the identity and confidence of members (index_id, global_id, confidence, seq),
    of several the one of highest seq, and with the time span of spans (index_id, start, end)."""
    last = members.groupBy("index_id").agg(F.max_by(F.struct("global_id", "confidence"), "seq").alias("m")).select("index_id", "m.*")
    return hits.join(last, "index_id", "left").join(spans, "index_id", "left")


def aligned(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of left with the right row of the same key, inner; of several right rows the last by order."""
    others = [c for c in right.columns if c not in keys]
    last = right.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(f"right_{c}") for c in others])
    return left.join(last, keys)


def resolved_runs(wanted: DataFrame, runs: DataFrame, contents: DataFrame, newest: int = 40) -> DataFrame:
    """(request, run, source): for each request the newest linked run that contains any of its tracks; else,
    among the `newest` youngest runs, the one with the best score: found tracks plus 1000 times rows of the
    request's camera. wanted: (request, camera_id, track_id), runs: (run, created, linked), contents: (run,
    camera_id, track_id)."""
    found = wanted.join(contents.withColumnRenamed("camera_id", "in_camera"), "track_id")
    hits = found.groupBy("request", "run").agg(F.count_distinct("track_id").alias("n"), F.count_if(F.col("camera_id") == F.col("in_camera")).alias("same_camera"))
    dated = hits.join(runs, "run")
    linked = dated.where("linked").groupBy("request").agg(F.max_by("run", F.struct("created", "run")).alias("run")).withColumn("source", F.lit("linked"))
    young = runs.orderBy(F.desc("created"), F.desc("run")).limit(newest).select("run")
    score = F.struct((F.col("n") + 1000 * F.col("same_camera")).alias("score"), "created", "run")
    scanned = dated.join(F.broadcast(young), "run", "left_semi").groupBy("request").agg(F.max_by("run", score).alias("run")).withColumn("source", F.lit("scanned"))
    return linked.unionByName(scanned.join(linked, "request", "left_anti"))


def trajectory_report(trajectories: DataFrame) -> DataFrame:
    """One row of counts and means of (num_tracklets, num_cameras, total_duration)."""
    return trajectories.agg(
        F.count("*").alias("total"), F.count_if(F.col("num_cameras") > 1).alias("multi_camera"), F.count_if(F.col("num_cameras") == 1).alias("single_camera"),
        F.coalesce(F.sum("num_tracklets"), F.lit(0)).alias("total_tracklets"), F.avg("total_duration").alias("avg_duration"), F.max("total_duration").alias("max_duration"),
        F.avg("num_cameras").alias("avg_cameras"), F.max("num_cameras").alias("max_cameras"),
    )


def graph_report(nodes: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """One row: nodes, edges from the threshold on, components and their sizes, mean weight, density."""
    kept = edges.where(F.col("sim") >= threshold)
    found = components(kept.select(F.col("i").alias("a"), F.col("j").alias("b")))
    sizes = nodes.join(found, "node", "left").groupBy(F.coalesce("component", "node").alias("c")).agg(F.count("*").alias("n"))
    a = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("num_nodes"), F.count("*").alias("num_components"), F.coalesce(F.max("n"), F.lit(0)).alias("max_component_size"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean_component_size"))
    b = kept.agg(F.count("*").alias("num_edges"), F.coalesce(F.avg("sim"), F.lit(0.0)).alias("mean_edge_weight"))
    one = a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").drop("k")
    pairs = F.col("num_nodes") * (F.col("num_nodes") - 1)
    return one.withColumn("density", F.coalesce(F.try_divide(2.0 * F.col("num_edges"), pairs), F.lit(0.0)))


def pair_funnel(truth: DataFrame, stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """(stage, n, lost): how many true pairs (i, j) each stage's pairs still hold, and lost since the one before."""
    marked = truth.select("i", "j")
    for k, (_, pairs) in enumerate(stages):
        marked = marked.join(pairs.select("i", "j").distinct().withColumn(f"in{k}", F.lit(1)), ["i", "j"], "left")
    counts = [F.count("*").alias("n"), *[F.sum(F.coalesce(f"in{k}", F.lit(0))).alias(f"n{k}") for k in range(len(stages))]]
    return counted_funnel(marked.agg(*counts), [name for name, _ in stages])


def counted_funnel(counts: DataFrame, stages: list[str]) -> DataFrame:
    """(stage, n, lost) of one row (n, n0, n1, ...): all true pairs and those that each stage still holds."""
    before = ["n", *[f"n{k}" for k in range(len(stages))]]
    rows = [F.struct(F.lit(name).alias("stage"), F.col(f"n{k}").alias("n"), (F.col(before[k]) - F.col(f"n{k}")).alias("lost")) for k, name in enumerate(stages)]
    return counts.select(F.inline(F.array(*rows)))


def fusion_advice(correlation: Column, agreement: Column, map_a: Column, map_b: Column) -> Column:
    """Whether to fuse two models: no-go when their ranks agree or the second is far weaker; go when ranks
    differ, first places differ and the second is strong enough; else marginal."""
    ratio = F.try_divide(map_b, map_a)
    apart = (correlation < 0.70) & (agreement < 75)
    return (
        F.when(correlation.isNull(), "marginal")
        .when((correlation >= 0.85) | F.coalesce(ratio < 0.65, F.lit(False)), "no-go")
        .when(ratio.isNotNull() & F.coalesce(apart, F.lit(False)), "go")
        .otherwise("marginal")
    )


def stratified_crops(crops: DataFrame, k: int, total: str = "total_frames") -> DataFrame:
    """(key columns, event_id, place): at most k crops of each tracklet (frame_id, quality, total_frames): the
    best of each of max(2, k // 2) time strata first, then the best of the rest; placed by quality. Tracklets
    with k crops or fewer keep all."""
    strata = max(2, k // 2)
    w = Window.partitionBy(*KEY)
    best = [F.desc("quality"), F.col("frame_id"), F.col("event_id")]
    stratum = F.least(F.floor(F.col("frame_id") / F.col(total) * strata), F.lit(strata - 1))
    cut = crops.withColumns({"n": F.count("*").over(w), "stratum": F.when(F.col(total) > 1, stratum).otherwise(0)})
    first = F.row_number().over(Window.partitionBy(*KEY, "stratum").orderBy(*best)) == 1
    cut = cut.withColumn("first", first & (F.col("n") > k) & (F.col(total) > 1))
    cut = cut.withColumn("turn", F.row_number().over(w.orderBy(F.desc("first"), *best))).where(F.col("turn") <= k)
    return cut.select(*KEY, "event_id", F.row_number().over(w.orderBy(*best)).alias("place"))


def drawn_frames(rows: DataFrame, max_gap: int) -> DataFrame:
    """Rows and ones in between for drawing: in gaps of 2 to max_gap frames box and confidence go over
    linearly."""
    w = Window.partitionBy(*KEY).orderBy(*ORDER)
    numbers = ("x", "y", "w", "h", "confidence")
    ahead = rows.select(*KEY, "frame_id", *numbers, F.lead("frame_id").over(w).alias("to"), *[F.lead(c).over(w).alias(f"{c}_to") for c in numbers])
    gap = ahead.where((F.col("to") - F.col("frame_id") > 1) & (F.col("to") - F.col("frame_id") <= max_gap))
    steps = gap.withColumn("at", F.explode(F.sequence(F.col("frame_id") + 1, F.col("to") - 1)))
    share = (F.col("at") - F.col("frame_id")) / (F.col("to") - F.col("frame_id"))
    made = steps.select(*KEY, F.col("at").alias("frame_id"), *[(F.col(c) + (F.col(f"{c}_to") - F.col(c)) * share).alias(c) for c in numbers])
    return rows.select(*KEY, "frame_id", *numbers).unionByName(made)


#: Order of alert levels, the most urgent first.
LEVELS = ("HIGH", "MEDIUM", "LOW")


def by_urgency(hits: DataFrame) -> DataFrame:
    """Hits (level, best, ...) with their place by level, then similarity."""
    rank = F.coalesce(*[F.when(F.col("level") == x, F.lit(k)) for k, x in enumerate(LEVELS)], F.lit(len(LEVELS)))
    return hits.withColumn("rank", rank).orderBy("rank", F.desc("best"), "probe_id", "pid")


#: Sort orders of a gallery of trajectories.
GALLERY_ORDERS = {
    "id": [("global_id", False)],
    "cameras": [("num_cameras", True), ("global_id", False)],
    "duration": [("total_duration", True), ("global_id", False)],
    "confidence": [("confidence", True), ("global_id", False)],
}


def gallery_page(trajectories: DataFrame, order: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of the gallery in one of GALLERY_ORDERS."""
    if order not in GALLERY_ORDERS:
        raise ValueError(f"unknown order {order}: one of {', '.join(GALLERY_ORDERS)}")
    return trajectories.orderBy(*[F.desc(c) if down else F.asc(c) for c, down in GALLERY_ORDERS[order]]).offset(offset).limit(limit)


def camera_pair_bias(features: DataFrame, truth: DataFrame) -> DataFrame:
    """(cam_a, cam_b, bias), in both orders: the mean cosine of true pairs of two cameras less the mean of such
    means. truth: (index_id, gt_id). Sums over a pair of cameras and an identity are products of the sums of
    vectors, so no pair of rows is built."""
    known = features.join(truth.where("gt_id >= 0"), "index_id")
    total = summed(known.select("gt_id", "camera_id", "v", F.lit(1.0).alias("weight")), ["gt_id", "camera_id"]).join(known.groupBy("gt_id", "camera_id").agg(F.count("*").alias("n")), ["gt_id", "camera_id"])
    a, b = total.toDF("gt_id", "cam_a", "a", "n_a"), total.toDF("gt_id", "cam_b", "b", "n_b")
    pairs = a.join(b, "gt_id").where("cam_a < cam_b").groupBy("cam_a", "cam_b").agg((F.sum(dot("a", "b")) / F.sum(F.col("n_a") * F.col("n_b"))).alias("mean"))
    bias = pairs.withColumn("k", F.lit(1)).join(pairs.agg(F.avg("mean").alias("every"), F.lit(1).alias("k")), "k").select("cam_a", "cam_b", (F.col("mean") - F.col("every")).alias("bias"))
    return bias.unionByName(bias.select(F.col("cam_b").alias("cam_a"), F.col("cam_a").alias("cam_b"), "bias"))


def bias_added(pairs: DataFrame, bias: DataFrame) -> DataFrame:
    """Pairs (score, camera_i, camera_j) with the cameras' bias (cam_a, cam_b, bias) added; pairs of cameras that
    it doesn't list stay."""
    b = bias.select(F.col("cam_a").alias("camera_i"), F.col("cam_b").alias("camera_j"), "bias")
    return pairs.join(b, ["camera_i", "camera_j"], "left").withColumn("score", F.col("score") + F.coalesce("bias", F.lit(0.0))).drop("bias")


def classified_zones(points: DataFrame, zones: DataFrame) -> DataFrame:
    """Points (camera_id, x, y, ...) with the first zone (camera_id, zone, x1, y1, x2, y2) by name that holds them,
    null outside of all."""
    held = zones.groupBy("camera_id").agg(F.array_sort(F.collect_list(F.struct("zone", "x1", "y1", "x2", "y2"))).alias("zones"))  # few zones a camera
    inside = F.filter("zones", lambda z: (F.col("x") >= z["x1"]) & (F.col("x") <= z["x2"]) & (F.col("y") >= z["y1"]) & (F.col("y") <= z["y2"]))
    return points.join(held, "camera_id", "left").withColumn("zone", F.get(F.transform(inside, lambda z: z["zone"]), F.lit(0))).drop("zones")


def zone_scores(links: DataFrame, transitions: DataFrame) -> DataFrame:
    """Links (source_camera, source_zone, target_camera, target_zone, gap) scored by transitions (the same four,
    min_time, max_time, weight): 0.5 where a zone isn't known, the weight where the gap fits, else 0."""
    keys = ["source_camera", "source_zone", "target_camera", "target_zone"]
    joined = links.join(transitions, keys, "left")
    unknown = F.col("source_zone").isNull() | F.col("target_zone").isNull()
    fits = F.col("gap").between(F.col("min_time"), F.col("max_time"))
    return joined.withColumn("score", F.when(unknown, 0.5).when(fits, F.col("weight")).otherwise(0.0)).drop("min_time", "max_time", "weight")


def lifted_edges(edges: DataFrame, seeds: DataFrame, threshold: float, margin: float) -> DataFrame:
    """(i, j, sim): edges and seed pairs (i, j, weight) of reciprocal best matches. A seed counts where there
    is no edge, and seeds below threshold + margin are lifted just above it, so that no pruning of bridges
    cuts them."""
    lift = threshold + margin
    both = edges.select("i", "j", "sim").join(seeds.select("i", "j", "weight"), ["i", "j"], "full")
    sim = F.when(F.col("weight").isNotNull() & (F.col("weight") < lift), lift + 0.01).otherwise(F.coalesce("sim", "weight"))
    return both.select("i", "j", sim.alias("sim"))


def evaluation_subset(queries: DataFrame, gallery: DataFrame, max_queries: int, max_gallery: int) -> tuple[DataFrame, DataFrame]:
    """Queries and gallery rows (item, pid, camera_id, in order of item): the first queries of different ids that
    have a match from another camera; for each the first such match, then the first other rows that don't
    share id and camera with a chosen query, up to max_gallery in all. Both limits are what is asked for."""
    has = gallery.select("pid", F.col("camera_id").alias("other")).distinct()
    valid = queries.join(has, "pid").where(F.col("camera_id") != F.col("other")).select(*queries.columns).distinct()
    first = valid.groupBy("pid").agg(F.min_by(F.struct(*queries.columns), "item").alias("q")).select("q.*")
    chosen = first.orderBy("item").limit(max_queries)
    asked = F.broadcast(chosen.select("pid", F.col("camera_id").alias("asked_camera")))  # at most max_queries rows
    met = gallery.join(asked, "pid", "left")
    needed = met.where(F.col("camera_id") != F.col("asked_camera")).groupBy("pid").agg(F.min_by(F.struct(*gallery.columns), "item").alias("g")).select("g.*")
    other = met.where(F.col("asked_camera").isNull() | (F.col("camera_id") != F.col("asked_camera"))).select(*gallery.columns)
    rest = other.join(needed.select("item"), "item", "left_anti").orderBy("item").limit(max_gallery)
    ranked = needed.withColumn("rank", F.lit(0)).unionByName(rest.withColumn("rank", F.lit(1)))  # max_queries + max_gallery rows at most
    placed = ranked.withColumn("r", F.row_number().over(Window.orderBy("rank", "item")))
    return chosen, placed.where((F.col("rank") == 0) | (F.col("r") <= max_gallery)).select(*gallery.columns)


def compared(before: DataFrame, after: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, before, after, delta) of two reports; a key that one of them lacks has nulls."""

    def long(frame: DataFrame, name: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics])
        return frame.select(*keys, F.inline(cells))

    both = long(before, "before").join(long(after, "after"), [*keys, "metric"], "full")
    return both.withColumn("delta", F.col("after") - F.col("before"))


def parameter_grid(frame: DataFrame, grid: dict[str, list[float]]) -> DataFrame:
    """One row of the grid's columns for each combination, in the given order."""
    out = frame.sparkSession.range(1).select(F.lit(1).alias("one"))
    for name, values in grid.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out.drop("one")


def grid_counts(pairs: DataFrame, thresholds: list[float], margins: list[float]) -> DataFrame:
    """(threshold, margin, kept, strong): a run for each point of a parameter grid, all in one pass: pairs from the
    threshold on, and from threshold plus margin on."""
    points = [(t, m) for t in thresholds for m in margins]
    counts = [F.count_if(F.col("sim") >= t).alias(f"k{k}") for k, (t, _) in enumerate(points)] + [F.count_if(F.col("sim") >= t + m).alias(f"s{k}") for k, (t, m) in enumerate(points)]
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(m).alias("margin"), F.col(f"k{k}").alias("kept"), F.col(f"s{k}").alias("strong")) for k, (t, m) in enumerate(points)])
    return pairs.agg(*counts).select(F.inline(rows))


def summary_lines(stats: DataFrame) -> DataFrame:
    """(place, line): a run's summary as text, a line for all and one for each camera."""
    every = stats.agg(F.count("*").alias("n"), F.count_distinct("camera_id").alias("cameras"), F.sum("num_frames").alias("frames"))
    head = every.select(F.lit("").alias("place"), F.format_string("%d tracklets in %d cameras, %d boxes", "n", "cameras", "frames").alias("line"))
    own = stats.groupBy("camera_id").agg(F.count("*").alias("n"), F.sum("num_frames").alias("frames"))
    return head.unionByName(own.select(F.col("camera_id").alias("place"), F.format_string("%s: %d tracklets, %d boxes", "camera_id", "n", "frames").alias("line")))


def visible_points(points: DataFrame, cameras: list[list[list[float]]], width: int, height: int, body: float = 175.0) -> DataFrame:
    """Ground points (x, y) of which any camera (a list of 3x4 projections) sees the foot or the head."""
    seen = F.lit(False)
    for projection in cameras:
        for z in (0.0, body):
            u, v = to_image(F.col("x"), F.col("y"), F.lit(z), projection)
            seen = seen | F.coalesce(u.between(0, width - 1) & v.between(0, height - 1), F.lit(False))
    return points.where(seen)


def body_box(x: Column, y: Column, projection: list[list[float]], width: int, height: int, body: float = 175.0, ratio: float = 0.4) -> Column:
    """The box (x1, y1, x2, y2) of a person who stands at a ground point: as high as foot and head are apart (20
    at least), `ratio` as wide (10 at least), clipped to the image; null outside or behind."""
    (fu, fv), (hu, hv) = to_image(x, y, F.lit(0.0), projection), to_image(x, y, F.lit(body), projection)
    high = F.greatest(F.lit(20.0), F.abs(fv - hv))
    wide = F.greatest(F.lit(10.0), high * ratio)
    x1, x2, y1, y2 = fu - wide / 2, fu + wide / 2, fv - high, fv
    inside = (x2 >= 0) & (y2 >= 0) & (x1 <= width) & (y1 <= height) & hu.isNotNull()

    def clip(v: Column, top: int) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(float(top - 1)), v))

    box = F.struct(clip(x1, width).alias("x1"), clip(y1, height).alias("y1"), clip(x2, width).alias("x2"), clip(y2, height).alias("y2"))
    return F.when(inside & (clip(x2, width) > clip(x1, width)) & (clip(y2, height) > clip(y1, height)), box)


def projected_tracks(points: DataFrame, cameras: dict[str, list[list[float]]], width: int, height: int) -> DataFrame:
    """(camera_id, track_id, frame_id, x1, y1, x2, y2): ground tracks (track_id, frame_id, x, y) as boxes in every
    camera that sees them."""
    boxes = F.array(*[F.struct(F.lit(c).alias("camera_id"), body_box(F.col("x"), F.col("y"), p, width, height).alias("box")) for c, p in sorted(cameras.items())])
    out = points.select("track_id", "frame_id", F.inline(boxes)).where("box is not null")
    return out.select("camera_id", "track_id", "frame_id", "box.*")


def hull_corners(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of distinct points, counter-clockwise from the leftmost (lowest on ties)."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points
    sides = []
    for run in (points, points[::-1]):
        side: list[np.ndarray] = []
        for p in run:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (p[1] - side[-2][1]) - (side[-1][1] - side[-2][1]) * (p[0] - side[-2][0]) <= 0:
                side.pop()
            side.append(p)
        sides.append(side[:-1])
    return np.array(sides[0] + sides[1])


def hull(points: DataFrame, key: str) -> DataFrame:
    """(key, place, x, y): the corners of the convex hull of each key's points (x, y). Tasks keep the corners of
    their own points, and only those are put together."""
    kind = dict(points.dtypes)[key]

    def own(batches):
        for part in batches:
            for k, same in part.groupby(key):
                corners = hull_corners(same[["x", "y"]].to_numpy(dtype=float))
                yield pd.DataFrame({key: k, "x": corners[:, 0], "y": corners[:, 1]})

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        corners = hull_corners(part[["x", "y"]].to_numpy())
        return pd.DataFrame({key: part[key].iloc[0], "place": np.arange(len(corners)), "x": corners[:, 0], "y": corners[:, 1]})

    some = points.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(f"{key} is not null and x is not null and y is not null")
    partial = some.mapInPandas(own, f"{key} {kind}, x double, y double")
    return partial.groupBy(key).applyInPandas(whole, f"{key} {kind}, place long, x double, y double")


def first_boxes(rows: DataFrame) -> DataFrame:
    """Each tracklet's first box."""
    return rows.groupBy(*KEY).agg(F.min_by(F.struct("x", "y", "w", "h"), place()).alias("b")).select(*KEY, "b.*")
