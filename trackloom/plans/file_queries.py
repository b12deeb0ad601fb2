"""Queries of file formats: what is written from the tables is read back and compared with SQL over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import reports as B
from trackloom.operators import tracklets as T
from trackloom.plans.registry import query
from trackloom.plans.report_queries import _trajectories
from trackloom.plans.vector_queries import FT, GT, _boxes
from trackloom.plans.views import DETECTIONS, STATS, detections, features
from trackloom.sinks import files as sinks
from trackloom.sources import files as sources
from trackloom.sources import tracking
from trackloom.tables import scratch_dir

D = f"WITH {DETECTIONS} "
S = f"WITH {STATS} "


def _text(frame, path):
    frame.write.text(path)
    return path


@query("src09_frame_manifest", D + "SELECT DISTINCT frame_id, camera_id, frame_id / 10.0::DOUBLE AS timestamp, camera_id || '/' || frame_id || '.jpg' AS frame_path, 400 AS width, 300 AS height FROM det")
def src09(spark, sf):
    path, frames = scratch_dir(spark), detections(spark, sf).select("frame_id", "camera_id").distinct()
    frames.select("*", (F.col("frame_id") / 10).alias("timestamp"), F.concat_ws("", "camera_id", F.lit("/"), "frame_id", F.lit(".jpg")).alias("frame_path"), F.lit(400).alias("width"), F.lit(300).alias("height")).write.json(path)
    return spark.read.schema("frame_id bigint, camera_id string, timestamp double, frame_path string, width int, height int").json(path)


@query("src11_matrix_rows", FT + ", r AS (SELECT camera_id, index_id, v, row_number() OVER (PARTITION BY camera_id ORDER BY index_id) - 1 AS position FROM feat) SELECT camera_id || '.npy' AS file, position, unnest(range(len(v)))::INT AS dim, unnest(list_transform(v, lambda x: round(x, 6) + 0.0)) AS x FROM r")
def src11(spark, sf):
    """Matrices of each camera's vectors as .npy content, read back by place."""
    from pyspark.sql import Window

    w = Window.partitionBy("camera_id").orderBy("index_id")
    rows = features(spark, sf).select(F.concat("camera_id", F.lit(".npy")).alias("file"), (F.row_number().over(w) - 1).alias("position"), "v")
    packed = sinks.packed_matrix(rows)
    return sources.matrix_rows(packed.withColumnRenamed("file", "path")).select("file", "position", F.posexplode("v").alias("dim", "x")).withColumn("x", F.round("x", 6) + F.lit(0.0))


@query("src12_queries_by_place", FT + "SELECT index_id AS position, CASE WHEN index_id % 3 <> 0 THEN 2 END AS k, CASE WHEN index_id % 3 <> 0 THEN round(list_sum(v), 5) END AS total FROM feat")
def src12(spark, sf):
    rows = features(spark, sf).select(F.col("index_id").alias("position"), "v")
    path = scratch_dir(spark)
    tensors = rows.where("position % 3 <> 0").select("position", F.array("v", F.reverse("v")).alias("queries"))
    extra = rows.where("position % 50 = 0").select((-1 - F.col("position")).alias("position"), F.array("v", "v").alias("queries"))
    sinks.write_queries(tensors.unionByName(extra), path)
    joined = sources.with_queries(rows.select("position"), spark.read.parquet(path))
    return joined.select("position", F.when(F.col("queries").isNotNull(), F.size("queries")).alias("k"), F.round(F.aggregate(F.col("queries")[1], F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("src13_histogram_matrix", FT + "SELECT index_id, round(list_sum(list_transform(v[1:16], lambda x: abs(x))), 5) AS total FROM feat")
def src13(spark, sf):
    path = scratch_dir(spark)
    features(spark, sf).select("index_id", F.transform(F.slice("v", 1, 16), lambda x: F.abs(x)).alias("h")).write.parquet(path)
    return spark.read.schema("index_id bigint, h array<double>").parquet(path).select("index_id", F.round(F.aggregate("h", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("src17_ground_detections", D + "SELECT event_id % 1000 // 5 AS frame_id, event_id % 1000 AS raw_frame_id, -300 + x * 2.5 AS x_cm, -900 + y * 2.5 AS y_cm, 'txt' AS kind FROM det WHERE event_id % 1000 >= 5 UNION ALL SELECT event_id % 1000, event_id % 1000, -300 + x * 2.5, -900 + y * 2.5, 'txt' FROM det WHERE event_id % 1000 < 5 UNION ALL SELECT CASE WHEN event_id >= 5 THEN event_id // 5 ELSE event_id END, event_id, x, y, 'csv' FROM det WHERE event_id % 2 = 0 UNION ALL SELECT event_id, event_id + 1, x * 2, y * 2, 'json' FROM det WHERE event_id % 3 = 0")
def src17(spark, sf):
    """The three layouts: grid cells in text, centimetres in CSV, centimetres with raw frames in JSON."""
    rows, path = detections(spark, sf), scratch_dir(spark)
    _text(rows.select(F.concat_ws(" ", F.col("event_id") % 1000, "x", "y")), f"{path}/txt")
    rows.where("event_id % 2 = 0").select(F.col("event_id").alias("frame_id"), F.col("x").alias("x_world_cm"), F.col("y").alias("y_world_cm")).write.option("header", True).csv(f"{path}/csv")
    rows.where("event_id % 3 = 0").select(F.col("event_id").alias("frame_id"), (F.col("event_id") + 1).alias("raw_frame_id"), (F.col("x") * 2).alias("x_world_cm"), (F.col("y") * 2).alias("y_world_cm")).write.json(f"{path}/json")
    out = None
    for kind in ("txt", "csv", "json"):
        part = sources.read_ground_detections(spark, f"{path}/{kind}", kind, lines=True).select("frame_id", "raw_frame_id", "x_cm", "y_cm", F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


@query("src19_calibration", D + ", c AS (SELECT camera_id, count(*)::DOUBLE AS n, avg(x) / 1000 AS a, avg(y) / 1000 AS b FROM det GROUP BY camera_id) SELECT camera_id AS camera, round(n + 200, 6) AS focal, round(b * 100, 6) AS t, round(1 - (1 - cos(sqrt(a * a + b * b))) * b * b / (a * a + b * b), 9) AS r00, round((1 - cos(sqrt(a * a + b * b))) * a * b / (a * a + b * b), 9) AS r01 FROM c")
def src19(spark, sf):
    """XML files made from each camera's counts and means, read back as matrices."""
    c = detections(spark, sf).groupBy("camera_id").agg(F.count("*").cast("double").alias("n"), (F.avg("x") / 1000).alias("a"), (F.avg("y") / 1000).alias("b"))
    head, tail = F.lit("<?xml version='1.0'?><opencv_storage>"), F.lit("</opencv_storage>")
    inner = F.concat(head, F.lit("<camera_matrix type_id='opencv-matrix'><rows>3</rows><cols>3</cols><dt>d</dt><data> "), F.concat_ws(" ", F.col("n") + 200, F.lit(0.0), F.lit(320.0), F.lit(0.0), F.col("n") + 200, F.lit(240.0), F.lit("0. 0. 1.")), F.lit(" </data></camera_matrix>"), tail)
    outer = F.concat(head, F.lit("<rvec>"), F.concat_ws(" ", "a", "b", F.lit(0.0)), F.lit("</rvec><tvec>"), F.concat_ws(" ", F.lit(1.0), F.col("b") * 100, F.lit(3.0)), F.lit("</tvec>"), tail)
    texts = c.select("camera_id", inner.alias("inner"), outer.alias("outer"))
    cal = sources.calibration(texts.select(F.col("camera_id").alias("camera"), F.col("inner").alias("value")), texts.select(F.col("camera_id").alias("camera"), F.col("outer").alias("value")))
    return cal.select("camera", F.round(F.col("k")[0], 6).alias("focal"), F.round(F.col("tvec")[1], 6).alias("t"), F.round(F.col("r")[0], 9).alias("r00"), F.round(F.col("r")[1], 9).alias("r01"))


@query("src21_truth_boxes", D + "SELECT 'camera_id=' || camera_id AS camera_id, frame_id, track_id, x, y, w, h FROM det")
def src21(spark, sf):
    """Ground truth in a folder for each camera; part files are no pattern's own, so they are read by name."""
    path = scratch_dir(spark)
    line = F.concat_ws(",", "frame_id", "track_id", "x", "y", "w", "h", F.lit("1,-1,-1,-1"))
    detections(spark, sf).select("camera_id", line.alias("line")).repartition("camera_id").write.partitionBy("camera_id").text(path)
    return sources.read_truth_boxes(spark, path, patterns=("*.txt", "*/*.txt", "*/part-*"), by_folder=True)


@query("src25_zones", D + ", z AS (SELECT camera_id, round(avg(x), 3) AS cx, round(avg(y), 3) AS cy, round(max(x), 3) AS ex, count(*) AS n FROM det GROUP BY camera_id) SELECT camera_id, 'entry' AS side, 0 AS zone, cx, cy FROM z UNION ALL SELECT camera_id, 'entry', 1, cy, cx FROM z UNION ALL SELECT camera_id, 'exit', 0, ex, cy FROM z")
def src25(spark, sf):
    z = detections(spark, sf).groupBy("camera_id").agg(F.round(F.avg("x"), 3).alias("cx"), F.round(F.avg("y"), 3).alias("cy"), F.round(F.max("x"), 3).alias("ex"))
    info = F.struct(F.struct(F.array(F.array("cx", "cy"), F.array("cy", "cx")).alias("centers")).alias("entry_zones"), F.struct(F.array(F.array("ex", "cy")).alias("centers")).alias("exit_zones"))
    cameras = F.map_from_entries(F.collect_list(F.struct("camera_id", info)))
    path = scratch_dir(spark)
    z.agg(cameras.alias("cameras")).withColumn("transitions", F.create_map(F.lit("a:0->b:1"), F.lit(5), F.lit("b:0->a:0"), F.lit(1))).write.json(path)
    return sources.read_zones(spark, path)[0]


@query("src26_polygons", D + ", z AS (SELECT camera_id, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM det GROUP BY camera_id) SELECT camera_id, unnest([0, 1, 2, 3])::INT AS place, unnest([a, b, b, a]) AS x, unnest([c, c, d, d]) AS y FROM z")
def src26(spark, sf):
    z = detections(spark, sf).groupBy("camera_id").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
    corners = F.array(F.array("a", "c"), F.array("b", "c"), F.array("b", "d"), F.array("a", "d"))
    path = scratch_dir(spark)
    _text(z.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("camera_id", corners)))).alias("value")), path)
    return sources.read_polygons(spark, path)


@query("src14_trajectories", S + "SELECT track_id AS global_id, 0.0::DOUBLE AS confidence, count(DISTINCT camera_id) AS num_cameras FROM stats WHERE track_id % 2 = 0 GROUP BY track_id UNION ALL SELECT track_id, 0.5, 7 FROM stats WHERE track_id % 2 = 1 GROUP BY track_id")
def src14(spark, sf):
    """Old files (no confidence, names in camel case) and new ones."""
    stats, path = T.tracklet_stats(detections(spark, sf)), scratch_dir(spark)
    held = stats.groupBy("track_id").agg(F.collect_list(F.struct("camera_id", "track_id")).alias("tracklets"))
    held.where("track_id % 2 = 0").select(F.col("track_id").alias("globalId"), "tracklets").write.json(f"{path}/old")
    held.where("track_id % 2 = 1").select(F.col("track_id").alias("global_id"), F.lit(0.5).alias("confidence"), F.lit(7).alias("num_cameras"), "tracklets").write.json(f"{path}/new")
    return tracking.read_trajectories(spark, f"{path}/*").select("global_id", "confidence", "num_cameras")


_NMS = """, k AS (SELECT * FROM det WHERE confidence > 0.02 QUALIFY row_number() OVER (PARTITION BY camera_id, frame_id, track_id ORDER BY confidence DESC, event_id) = 1),
 n AS (SELECT *, row_number() OVER (PARTITION BY camera_id, frame_id ORDER BY confidence DESC, event_id) AS r FROM k),
 s AS (SELECT camera_id, frame_id, r, [{'e': event_id, 'x': x, 'y': y, 'w': w, 'h': h}] AS kept FROM n WHERE r = 1
  UNION ALL SELECT n.camera_id, n.frame_id, n.r, CASE WHEN len(list_filter(s.kept, lambda b: greatest(0, least(b.x + b.w, n.x + n.w) - greatest(b.x, n.x)) * greatest(0, least(b.y + b.h, n.y + n.h) - greatest(b.y, n.y))
   > 0.3 * (b.w * b.h + n.w * n.h - greatest(0, least(b.x + b.w, n.x + n.w) - greatest(b.x, n.x)) * greatest(0, least(b.y + b.h, n.y + n.h) - greatest(b.y, n.y))))) > 0 THEN s.kept
   ELSE list_append(s.kept, {'e': n.event_id, 'x': n.x, 'y': n.y, 'w': n.w, 'h': n.h}) END FROM s JOIN n ON n.camera_id = s.camera_id AND n.frame_id = s.frame_id AND n.r = s.r + 1 AND n.r <= {limit}),
 f AS (SELECT camera_id, frame_id, kept FROM s QUALIFY row_number() OVER (PARTITION BY camera_id, frame_id ORDER BY r DESC) = 1), o AS (SELECT camera_id, frame_id, unnest(kept).e AS event_id FROM f) """


@query("snk04_submission", D.replace("WITH", "WITH RECURSIVE") + _NMS.replace("{limit}", "3") + "SELECT o.camera_id, k.frame_id + 1 AS frame_id, k.track_id, k.x, k.y, k.w, k.h FROM o JOIN k USING (event_id)")
def snk04(spark, sf):
    path = scratch_dir(spark)
    sinks.write_submission(detections(spark, sf), path, min_confidence=0.02, max_iou=0.3, per_frame=3)
    lines = spark.read.text(path).select("camera_id", F.split("value", ",").alias("c"))
    names = ("frame_id", "track_id", "x", "y", "w", "h")
    return lines.select("camera_id", *[F.col("c")[k].cast("bigint" if k < 2 else "double").alias(n) for k, n in enumerate(names)])


@query("nms01_suppressed", ("WITH RECURSIVE " + DETECTIONS).replace("epoch_us(ts) // 3600000000 AS frame_id", "epoch_us(ts) // 86400000000 AS frame_id, epoch_us(ts) // 3600000000 AS hour") + _NMS.replace("k AS (SELECT * FROM det WHERE confidence > 0.02 QUALIFY row_number() OVER (PARTITION BY camera_id, frame_id, track_id ORDER BY confidence DESC, event_id) = 1)", "k AS (SELECT * FROM det)").replace(" AND n.r <= {limit}", "") + "SELECT o.camera_id, o.frame_id AS day, o.event_id FROM o")
def nms01(spark, sf):
    return T.suppressed(detections(spark, sf).withColumn("day", F.expr("frame_id div 24")), 0.3, "day").select("camera_id", "day", "event_id")


@query("snk08_exports", D + ", t AS (SELECT track_id, camera_id, count(*) AS n, min(frame_id) AS a, max(frame_id) AS b FROM det GROUP BY ALL) SELECT 'csv' AS kind, track_id || ',' || camera_id || ',' || n || ',' || a || ',' || b AS line FROM t UNION ALL SELECT 'mot', frame_id || ',' || track_id || ',' || printf('%.2f', x) || ',' || printf('%.2f', y) || ',' || printf('%.2f', w) || ',' || printf('%.2f', h) || ',-1,-1,-1' FROM det")
def snk08(spark, sf):
    """Without trajectories the CSV export falls back to tracklets; of the boxes all but the confidence is compared."""
    rows = detections(spark, sf)
    csv = sinks.export_lines(None, rows, "csv").select(F.lit("csv").alias("kind"), "line")
    mot = sinks.export_lines(None, rows, "mot").select(F.lit("mot").alias("kind"), F.regexp_replace("line", r",[0-9.]+,-1,-1,-1$", ",-1,-1,-1").alias("line"))
    return csv.unionByName(mot)


@query("snk08_trajectory_export", S + "SELECT track_id AS global_id, count(DISTINCT camera_id) AS num_cameras, sum(end_frame - start_frame)::BIGINT AS total_duration FROM stats GROUP BY track_id")
def snk08_trajectories(spark, sf):
    path = scratch_dir(spark)
    _text(sinks.export_lines(_trajectories(spark, sf), detections(spark, sf), "json").select("line"), path)
    return spark.read.schema("global_id bigint, num_cameras bigint, total_duration bigint").json(path)


@query("snk12_ablation_csv", GT + "SELECT 'loose' AS variant, count(*) AS n FROM m UNION ALL SELECT 'strict', count(*) FROM m WHERE iou >= 0.6")
def snk12(spark, sf):
    from trackloom.operators import evaluation

    rows, truth = _boxes(spark, sf)
    path = scratch_dir(spark)
    variants = {name: evaluation.box_matches(rows, truth, least).agg(F.count("*").alias("n")) for name, least in (("loose", 0.3), ("strict", 0.6))}
    sinks.write_ablation(evaluation.ablation(variants), path)
    return spark.read.schema("variant string, n bigint").option("header", True).csv(path)


@query("snk13_ground_tracks", D + "SELECT track_id, frame_id, frame_id AS raw_frame_id, printf('%.3f', x * 2.5 - 300) AS x_world_cm, printf('%.3f', y * 2.5 - 900) AS y_world_cm FROM det")
def snk13(spark, sf):
    path = scratch_dir(spark)
    points = detections(spark, sf).select("track_id", "frame_id", F.lit(None).cast("long").alias("raw_frame_id"), (F.col("x") * 2.5 - 300).alias("x"), (F.col("y") * 2.5 - 900).alias("y"), F.col("confidence").alias("score"))
    sinks.write_ground_tracks(points, path)
    back = spark.read.schema("track_id bigint, frame_id bigint, raw_frame_id bigint, x_world_cm string, y_world_cm string, score string").option("header", True).csv(f"{path}/csv")
    return back.drop("score")


@query("prj12_alert_levels", S + "SELECT camera_id, track_id, CASE WHEN round(mean_confidence * 5, 9) >= 0.6 THEN 'HIGH' WHEN round(mean_confidence * 5, 9) >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM stats")
def prj12(spark, sf):
    from trackloom.operators.scoring import alert_level

    return T.tracklet_stats(detections(spark, sf)).select("camera_id", "track_id", alert_level(F.col("mean_confidence"), F.lit(5.0)).alias("level"))


@query("snk15_first_boxes", D + "SELECT camera_id, track_id, x, y, w, h FROM det QUALIFY row_number() OVER (PARTITION BY camera_id, track_id ORDER BY frame_id, event_id) = 1")
def snk15(spark, sf):
    return B.first_boxes(detections(spark, sf))


def _people(spark, sf):
    """Per-frame JSON of people: a person's first entry counts; views of negative or empty boxes don't."""
    view = F.struct((F.col("event_id") % 3).cast("int").alias("viewNum"), (F.col("x") - 20).alias("xmin"), F.col("y").alias("ymin"), (F.col("x") - 20 + F.when(F.col("event_id") % 7 == 0, 0.0).otherwise(F.col("w"))).alias("xmax"), (F.col("y") + F.col("h")).alias("ymax"))
    person = F.struct(F.col("event_id").alias("order"), F.col("track_id").alias("personID"), (F.col("event_id") % 100_000).alias("positionID"), F.array(view).alias("views"))
    return detections(spark, sf).groupBy("frame_id").agg(F.to_json(F.array_sort(F.collect_list(person))).alias("value"))


_FIRST = D + ", v AS (SELECT *, x - 20 AS xa, CASE WHEN event_id % 7 = 0 THEN x - 20 ELSE x - 20 + w END AS xb FROM det) "


@query("src18_ground_truth", _FIRST + "SELECT frame_id, track_id AS person_id, -300 + (event_id % 100000 % 480) * 2.5::DOUBLE AS x_cm, -900 + floor(event_id % 100000 / 480) * 2.5::DOUBLE AS y_cm FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY frame_id, track_id ORDER BY event_id) = 1) WHERE xa >= 0 AND xb > xa")
def src18(spark, sf):
    return tracking.ground_truth(_people(spark, sf))


@query("src08_ground_views", _FIRST + "SELECT frame_id, track_id, 'C' || (event_id % 3 + 1) AS camera_id, xa AS xmin, y AS ymin, xb AS xmax, y + h AS ymax FROM v WHERE xa >= 0 AND y >= 0 AND xb > xa")
def src08(spark, sf):
    return tracking.ground_views(_people(spark, sf))
