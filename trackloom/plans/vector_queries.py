"""Queries of vectors, similarity joins, scores, clusters, searches and evaluation over features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.functions import vectors as V
from trackloom.functions.geometry import iou_xywh
from trackloom.operators import communities, evaluation, expansion, graphs, scoring, search, simjoin, trajectories
from trackloom.operators import vectors as P
from trackloom.operators.components import components
from trackloom.plans.registry import query
from trackloom.plans.views import DETECTIONS, FEATURES, PAIRS, SCORED, chopped, detections, edges, features, table, timed_edges

FT = f"WITH {FEATURES} "
PR = f"WITH {PAIRS} "
SC = f"WITH {SCORED} "
DT = f"WITH {DETECTIONS} "

#: Pairs ranked from both ends, over all candidate pairs.
BOTH = PR + ", both_ AS (SELECT i, j, sim, camera_j AS other FROM pairs UNION ALL SELECT j, i, sim, camera_i FROM pairs) "
#: The same over edges.
EDGES_BOTH = PR + ", both_ AS (SELECT i, j, sim, camera_j AS other FROM edges UNION ALL SELECT j, i, sim, camera_i FROM edges) "


def _round(frame, *names, digits=6):
    return frame.withColumns({n: F.round(n, digits) for n in names})


def entries(frame, key="index_id", digits=5):
    """A row for each component of the vectors; negative zeros count as zero."""
    return frame.select(key, F.posexplode("v").alias("dim", "x")).withColumn("x", F.round("x", digits) + F.lit(0.0))


@query("win01_mutual_topk", BOTH + ", r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS place FROM both_) SELECT a.i, a.j, round(a.sim, 6) AS sim FROM r a JOIN r b ON a.i = b.j AND a.j = b.i WHERE a.place <= 5 AND b.place <= 5 AND a.i < a.j")
def win01(spark, sf):
    return _round(simjoin.mutual_nearest(features(spark, sf), 5), "sim")


@query("jn03_similar_pairs", PR + "SELECT i, j, round(sim, 6) AS sim FROM edges")
def jn03(spark, sf):
    return _round(simjoin.similar_pairs(features(spark, sf), 0.25), "sim")


@query("vec01_nearest", BOTH + "SELECT i, j, round(sim, 6) AS sim, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS place FROM both_ QUALIFY place <= 3")
def vec01(spark, sf):
    return _round(simjoin.nearest(features(spark, sf), 3), "sim").withColumn("place", F.col("place").cast("long"))


@query("win01_edge_topk", EDGES_BOTH + ", r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS place FROM both_) SELECT a.i, a.j, round(a.sim, 6) AS sim FROM r a JOIN r b ON a.i = b.j AND a.j = b.i JOIN edges e ON e.i = a.i AND e.j = a.j WHERE a.place <= 2 AND b.place <= 2")
def win01_edges(spark, sf):
    return _round(simjoin.mutual_topk(edges(spark, sf).select("i", "j", "sim"), 2), "sim")


@query("win02_reciprocal_best", EDGES_BOTH + ", r AS (SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY i, other ORDER BY sim DESC, j) = 1) SELECT a.i, a.j, round(least(a.sim, b.sim), 6) AS weight FROM r a JOIN r b ON a.i = b.j AND a.j = b.i WHERE a.i < a.j")
def win02(spark, sf):
    rows = features(spark, sf)
    return _round(simjoin.reciprocal_best(edges(spark, sf), rows.select("index_id", "camera_id"), 0.25), "weight")


@query("win03_csls", EDGES_BOTH + ", m AS (SELECT i, avg(sim) AS mean FROM (SELECT i, sim FROM both_ QUALIFY row_number() OVER (PARTITION BY i ORDER BY sim DESC) <= 3) GROUP BY i) SELECT e.i, e.j, round(2 * e.sim - a.mean - b.mean, 6) AS sim FROM edges e JOIN m a ON e.i = a.i JOIN m b ON e.j = b.i")
def win03(spark, sf):
    return _round(simjoin.csls(edges(spark, sf), 3), "sim")


@query("set06_merged_edges", PR + ", more AS (SELECT i, j, 0.3::DOUBLE AS sim FROM edges WHERE i % 2 = 0) SELECT i, j, round(max(sim), 6) AS sim FROM (SELECT i, j, sim FROM edges UNION ALL SELECT * FROM more) GROUP BY i, j")
def set06(spark, sf):
    e = edges(spark, sf).select("i", "j", "sim")
    return _round(scoring.merged_edges(e, e.where("i % 2 = 0").withColumn("sim", F.lit(0.3))), "sim")


@query("vec02_normalized", FT + "SELECT index_id, round(list_sum(list_transform(v, lambda x: abs(x))) / greatest(sqrt(list_inner_product(v, v)), 1e-8), 6) AS l1 FROM feat")
def vec02(spark, sf):
    rows = features(spark, sf).withColumn("v", V.normalized("v"))
    return rows.select("index_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x)), 6).alias("l1"))


@query("vec03_cosine", FT + "SELECT a.index_id, round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 6) AS cos, round(list_inner_product(a.v, a.v) + list_inner_product(b.v, b.v) - 2 * list_inner_product(a.v, b.v), 5) AS d2 FROM feat a JOIN feat b ON b.index_id = a.index_id + 1")
def vec03(spark, sf):
    a = features(spark, sf).select("index_id", F.col("v").alias("a"))
    b = features(spark, sf).select((F.col("index_id") - 1).alias("index_id"), F.col("v").alias("b"))
    return a.join(b, "index_id").select("index_id", F.round(V.cosine("a", "b"), 6).alias("cos"), F.round(V.squared_distance("a", "b"), 5).alias("d2"))


@query("vec05_standardized", FT + ", l AS (SELECT index_id, camera_id, unnest(v) AS x, unnest(range(len(v))) AS dim FROM feat), s AS (SELECT camera_id, dim, avg(x) AS m, stddev_pop(x) AS s FROM l GROUP BY ALL) SELECT index_id, dim::INT AS dim, round((x - m) / (s + 1e-8), 5) + 0.0 AS x FROM l JOIN s USING (camera_id, dim)")
def vec05(spark, sf):
    return entries(P.standardized_by(features(spark, sf)))


@query("vec06_power_norm", FT + ", p AS (SELECT index_id, list_transform(v, lambda x: sign(x) * sqrt(abs(x))) AS v FROM feat) SELECT index_id, unnest(range(len(v)))::INT AS dim, unnest(list_transform(v, lambda x: round(x / sqrt(list_inner_product(v, v)), 5) + 0.0)) AS x FROM p")
def vec06(spark, sf):
    return entries(features(spark, sf).withColumn("v", V.power_normalized("v", 0.5)))


@query("vec07_pca_whitened")
def vec07(spark, sf):
    rows = P.pca_whitened(features(spark, sf), 16)
    return rows.select("index_id", F.round(V.norm("v"), 4).alias("length"))


@query("vec09_camera_whitened")
def vec09(spark, sf):
    rows = P.camera_whitened(features(spark, sf))
    return rows.select("index_id", F.round(V.norm("v"), 4).alias("length"))


@query("vec10_cross_camera_augmented", BOTH + ", n AS (SELECT i, j, exp(sim / 0.08) AS e FROM both_ QUALIFY row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) <= 3), w AS (SELECT i, j, 0.5 * e / (sum(e) OVER (PARTITION BY i) + 1e-12) AS w FROM n), c AS (SELECT w.i AS index_id, w, v FROM w JOIN feat f ON f.index_id = w.j UNION ALL SELECT index_id, 0.5, v FROM feat WHERE index_id IN (SELECT i FROM n)), l AS (SELECT index_id, w, unnest(v) AS x, unnest(range(len(v))) AS dim FROM c), s AS (SELECT index_id, dim, sum(w * x) AS x FROM l GROUP BY ALL) SELECT index_id, dim::INT AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY index_id)), 5) + 0.0 AS x FROM s")
def vec10(spark, sf):
    rows = features(spark, sf)
    out = simjoin.cross_camera_augmented(rows, simjoin.nearest(rows, 3), 0.5, 0.08)
    return entries(out)


@query("vec12_query_expansion", BOTH + ", n AS (SELECT i, j FROM both_ QUALIFY row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) <= 3), c AS (SELECT i AS index_id, v FROM n JOIN feat f ON f.index_id = n.j UNION ALL SELECT index_id, v FROM feat), l AS (SELECT index_id, unnest(v) AS x, unnest(range(len(v))) AS dim FROM c), s AS (SELECT index_id, dim, sum(x) AS x FROM l GROUP BY ALL) SELECT index_id, dim::INT AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY index_id)), 5) + 0.0 AS x FROM s")
def vec12(spark, sf):
    rows = features(spark, sf)
    return entries(simjoin.averaged_query_expansion(rows, simjoin.nearest(rows, 3)))


@query("vec16_score_fusion", PR + "SELECT e.i, e.j, round(0.7 * e.sim + 0.3 * (1 - abs(e.i - e.j) / 2000.0::DOUBLE), 6) AS fused FROM edges e")
def vec16(spark, sf):
    e = edges(spark, sf)
    return e.select("i", "j", F.round(0.7 * F.col("sim") + 0.3 * (1 - F.abs(F.col("i") - F.col("j")) / F.lit(2000.0)), 6).alias("fused"))


@query("agg02_quality_pooled", FT + ", q AS (SELECT pid, v, exp(3 * ((index_id % 7) / 7.0::DOUBLE - max((index_id % 7) / 7.0::DOUBLE) OVER (PARTITION BY pid))) AS e FROM feat), w AS (SELECT pid, v, e / sum(e) OVER (PARTITION BY pid) AS w FROM q), l AS (SELECT pid, w, unnest(v) AS x, unnest(range(len(v))) AS dim FROM w), s AS (SELECT pid, dim, sum(w * x) AS x FROM l GROUP BY ALL) SELECT pid, dim::INT AS dim, round(x, 6) + 0.0 AS x FROM s")
def agg02(spark, sf):
    rows = features(spark, sf).withColumn("quality", (F.col("index_id") % 7) / F.lit(7.0))
    return entries(P.quality_pooled(rows, ["pid"], 3.0, unit=False), "pid", 6)


@query("agg04_mean_pooled", FT + ", l AS (SELECT pid, unnest(v) AS x, unnest(range(len(v))) AS dim FROM feat), s AS (SELECT pid, dim, avg(x) AS x FROM l GROUP BY ALL) SELECT pid, dim::INT AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY pid)), 5) + 0.0 AS x FROM s")
def agg04(spark, sf):
    return entries(P.mean_pooled(features(spark, sf), ["pid"]), "pid")


@query("agg05_median_pooled", FT + ", l AS (SELECT pid, unnest(v) AS x, unnest(range(len(v))) AS dim FROM feat), s AS (SELECT pid, dim, median(x) AS x FROM l GROUP BY ALL) SELECT pid, dim::INT AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY pid)), 5) + 0.0 AS x FROM s")
def agg05(spark, sf):
    return entries(P.median_pooled(features(spark, sf), ["pid"]), "pid")


def _weiszfeld(rounds):
    """SQL of the given number of rounds over unit vectors; no row is hit exactly and no step is short."""
    sql = "u AS (SELECT pid, index_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM feat), l AS (SELECT pid, index_id, unnest(v) AS x, unnest(range(len(v))) AS dim FROM u), c0 AS (SELECT pid, dim, avg(x) AS x FROM l GROUP BY ALL)"
    for k in range(1, rounds + 1):
        sql += f", d{k} AS (SELECT l.pid, l.index_id, 1 / sqrt(sum((l.x - c.x) ** 2)) AS w FROM l JOIN c{k - 1} c USING (pid, dim) GROUP BY ALL), c{k} AS (SELECT l.pid, dim, sum(w * x) / sum(w) AS x FROM l JOIN d{k} USING (pid, index_id) GROUP BY ALL)"
    return sql + f" SELECT pid, dim::INT AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY pid)), 5) + 0.0 AS x FROM c{rounds}"


@query("agg06_geometric_median", FT + ", " + _weiszfeld(4))
def agg06(spark, sf):
    return entries(P.geometric_median(features(spark, sf), ["pid"], rounds=4), "pid")


@query("agg07_medoid", FT + ", u AS (SELECT pid, index_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM feat), s AS (SELECT a.pid, a.index_id, sum(list_inner_product(a.v, b.v)) AS s FROM u a JOIN u b ON a.pid = b.pid GROUP BY ALL) SELECT pid, index_id FROM s QUALIFY row_number() OVER (PARTITION BY pid ORDER BY round(s, 9) DESC, index_id) = 1")
def agg07(spark, sf):
    return P.medoid(features(spark, sf), ["pid"])


@query("agg08_trimmed_pooled", FT + ", l AS (SELECT pid, unnest(v) AS x, unnest(range(len(v))) AS dim FROM feat), m AS (SELECT pid, list(x ORDER BY dim) AS c FROM (SELECT pid, dim, avg(x) AS x FROM l GROUP BY ALL) GROUP BY pid), r AS (SELECT f.pid, f.index_id, f.v, row_number() OVER (PARTITION BY f.pid ORDER BY list_inner_product(f.v, c) / sqrt(list_inner_product(f.v, f.v)) DESC, f.index_id) AS r, count(*) OVER (PARTITION BY f.pid) AS n FROM feat f JOIN m USING (pid)), k AS (SELECT pid, unnest(v) AS x, unnest(range(len(v))) AS dim FROM r WHERE r <= n - floor(n * 0.25)), s AS (SELECT pid, dim, avg(x) AS x FROM k GROUP BY ALL) SELECT pid, dim::INT AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY pid)), 5) + 0.0 AS x FROM s")
def agg08(spark, sf):
    return entries(P.trimmed_pooled(features(spark, sf), ["pid"], 0.25), "pid")


@query("sco01_temporal_overlap", SC + "SELECT i, j, CASE WHEN least(end_i, end_j) > greatest(start_i, start_j) THEN least(1.0, round((least(end_i, end_j) - greatest(start_i, start_j)) / least(end_i - start_i, end_j - start_j), 6)) ELSE 0 END AS overlap FROM timed")
def sco01(spark, sf):
    o = scoring.temporal_overlap(F.col("start_i"), F.col("end_i"), F.col("start_j"), F.col("end_j"))
    return timed_edges(spark, sf).select("i", "j", F.round(o, 6).alias("overlap"))


#: Priors of camera pairs, derived from the features' cameras.
PRIORS = ", cams AS (SELECT DISTINCT camera_id FROM feat), priors AS (SELECT a.camera_id AS cam_a, b.camera_id AS cam_b, 0.0::DOUBLE AS min_time, 12.0::DOUBLE AS max_time, 4.0::DOUBLE AS mean_time, 2.0::DOUBLE AS std_time FROM cams a JOIN cams b ON left(a.camera_id, 3) = left(b.camera_id, 3) AND a.camera_id < b.camera_id AND right(a.camera_id, 1) <> '4' AND right(b.camera_id, 1) <> '4') "
ORDERED = PRIORS + ", o AS (SELECT *, CASE WHEN start_i <= start_j THEN camera_i ELSE camera_j END AS ca, CASE WHEN start_i <= start_j THEN camera_j ELSE camera_i END AS cb, greatest(0, greatest(start_i, start_j) - least(end_i, end_j)) AS gap FROM timed), q AS (SELECT o.*, coalesce(f.min_time, b.min_time) AS lo, coalesce(f.max_time, b.max_time) AS hi, ca IN (SELECT cam_a FROM priors) OR cb IN (SELECT cam_a FROM priors) AS listed FROM o LEFT JOIN priors f ON f.cam_a = ca AND f.cam_b = cb LEFT JOIN priors b ON b.cam_a = cb AND b.cam_b = ca), st AS (SELECT *, CASE WHEN lo IS NOT NULL THEN CASE WHEN gap BETWEEN lo AND hi THEN exp(-0.5 * ((gap - 4) / 4) ** 2) ELSE 0 END WHEN listed THEN 0 WHEN gap <= 20 THEN exp(-0.5 * (gap / (20 / sqrt(2 * ln(100)))) ** 2) ELSE 0 END AS st FROM q) "


def _with_priors(spark, sf):
    cams = features(spark, sf).select("camera_id").distinct().where(~F.col("camera_id").endswith("4"))
    a, b = cams.select(F.col("camera_id").alias("cam_a"), F.substring("camera_id", 1, 3).alias("s")), cams.select(F.col("camera_id").alias("cam_b"), F.substring("camera_id", 1, 3).alias("s"))
    priors = a.join(b, "s").where("cam_a < cam_b").drop("s").withColumns({"min_time": F.lit(0.0), "max_time": F.lit(12.0), "mean_time": F.lit(4.0), "std_time": F.lit(2.0)})
    return scoring.with_priors(scoring.ordered_cameras(timed_edges(spark, sf)), priors)


@query("sco03_transition_score", SC + ORDERED + "SELECT i, j, round(st, 6) AS st FROM st")
def sco03(spark, sf):
    gap = F.greatest(F.lit(0.0), F.greatest("start_i", "start_j") - F.least("end_i", "end_j"))
    return _with_priors(spark, sf).select("i", "j", F.round(scoring.transition_score(gap, 0.0, 20.0), 6).alias("st"))


@query("sco05_combined_score", SC + ORDERED + "SELECT i, j, round((CASE WHEN class_id = 0 THEN 0.65 * sim + 0.10 * hsv_sim + 0.25 * st ELSE 0.5 * sim + 0.25 * hsv_sim + 0.25 * st END + CASE WHEN lo IS NOT NULL OR NOT listed THEN 0.05 * CASE WHEN least(end_i, end_j) > greatest(start_i, start_j) THEN least(1, (least(end_i, end_j) - greatest(start_i, start_j)) / least(end_i - start_i, end_j - start_j)) ELSE 0 END ELSE 0 END) * (0.5 + 0.5 * sqrt(least(frames_i, frames_j) / (least(frames_i, frames_j) + 10.0::DOUBLE))), 6) AS score FROM st WHERE st > 0")
def sco05(spark, sf):
    weights = scoring.Weights(length_power=0.5, overlap_bonus=0.05)
    return scoring.combined_score(_with_priors(spark, sf), weights, 0.0, 20.0).select("i", "j", F.round("score", 6).alias("score"))


CAMS = ", s AS (SELECT i, j, sim AS score, least(camera_i, camera_j) AS cam_a, greatest(camera_i, camera_j) AS cam_b FROM edges) "


def _scores(spark, sf):
    return edges(spark, sf).withColumnRenamed("sim", "score")


@query("agg16_recentred", PR + CAMS + ", m AS (SELECT cam_a, cam_b, avg(score) AS m FROM s GROUP BY ALL HAVING count(*) >= 5) SELECT i, j, round(score + coalesce((SELECT avg(m) FROM m) - m.m, 0), 6) AS score FROM s LEFT JOIN m USING (cam_a, cam_b)")
def agg16(spark, sf):
    return _round(scoring.recentred(_scores(spark, sf), 5), "score").select("i", "j", "score")


@query("agg17_camera_bias", PR + CAMS + "SELECT cam_a, cam_b, round(median(score), 6) AS bias FROM s GROUP BY ALL HAVING count(*) >= 3")
def agg17(spark, sf):
    return _round(scoring.camera_bias(_scores(spark, sf)), "bias")


@query("sco07_bias_adjusted", PR + CAMS + ", b AS (SELECT cam_a, cam_b, median(score) AS bias FROM s GROUP BY ALL HAVING count(*) >= 3) SELECT i, j, round(CASE WHEN bias > 0 THEN greatest(0, least(1, score + (SELECT avg(bias) FROM b) - bias)) ELSE score END, 6) AS score FROM s LEFT JOIN b USING (cam_a, cam_b)")
def sco07(spark, sf):
    rows = _scores(spark, sf)
    return _round(scoring.bias_adjusted(rows, scoring.camera_bias(rows)), "score").select("i", "j", "score")


@query("agg18_learned_priors", SC + ", g AS (SELECT least(camera_i, camera_j) AS cam_a, greatest(camera_i, camera_j) AS cam_b, abs(start_i - start_j) AS gap FROM timed) SELECT cam_a, cam_b, round(min(gap) * 0.8, 6) AS min_time, round(max(gap) * 1.2, 6) AS max_time, round(avg(gap), 6) AS mean_time, round(greatest(1, coalesce(stddev_samp(gap), (max(gap) - min(gap)) / 4)), 6) AS std_time, count(*) AS n FROM g GROUP BY ALL")
def agg18(spark, sf):
    links = timed_edges(spark, sf).select(F.least("camera_i", "camera_j").alias("cam_a"), F.greatest("camera_i", "camera_j").alias("cam_b"), F.abs(F.col("start_i") - F.col("start_j")).alias("gap"))
    return _round(scoring.learned_priors(links), "min_time", "max_time", "mean_time", "std_time")


@query("fil20_pair_threshold", PR + CAMS + "SELECT i, j FROM s WHERE score >= CASE WHEN right(cam_a, 1) = '0' THEN 0.3 ELSE 0.27 END")
def fil20(spark, sf):
    cams = features(spark, sf).select("camera_id").distinct()
    a, b = cams.select(F.col("camera_id").alias("cam_a"), F.substring("camera_id", 1, 3).alias("s")), cams.select(F.col("camera_id").alias("cam_b"), F.substring("camera_id", 1, 3).alias("s"))
    table_ = a.join(b, "s").where("cam_a < cam_b AND cam_a LIKE '%0'").select("cam_a", "cam_b", F.lit(0.3).alias("threshold"))
    return scoring.over_threshold(_scores(spark, sf), table_, 0.27).select("i", "j")


@query("sco11_boosted", PR + CAMS + "SELECT i, j, round(score + CASE WHEN (i + j) % 5 = 0 THEN 0.1 ELSE 0 END, 6) AS score FROM s")
def sco11(spark, sf):
    rows = _scores(spark, sf)
    boosts = rows.where("(i + j) % 5 = 0").select(F.col("j").alias("i"), F.col("i").alias("j"), F.lit(0.1).alias("boost"))
    return _round(scoring.boosted(rows, boosts), "score").select("i", "j", "score")


@query("sco09_zone_adjusted", PR + "SELECT i, j, round(sim + CASE WHEN (i % 4 + j % 4) % 2 = 1 THEN 0.05 WHEN i % 4 = j % 4 THEN -0.1 ELSE -0.1 END, 6) AS score FROM edges")
def sco09(spark, sf):
    rows = _scores(spark, sf).withColumns({"zone_i": F.col("i") % 4, "zone_j": F.col("j") % 4})
    zones = features(spark, sf).select((F.col("index_id") % 4).alias("z")).distinct()
    seen = zones.select(F.col("z").alias("zone_a"), F.explode(F.array(F.col("z") + 1, F.col("z") + 3)).alias("zone_b")).where("zone_b < 4")
    return _round(scoring.zone_adjusted(rows, seen, 0.05, 0.1), "score").select("i", "j", "score")


@query("jn17_nearest_zone", DT + ", z AS (SELECT * FROM (VALUES (0, 50.0, 50.0), (1, 300.0, 60.0), (2, 200.0, 250.0)) t(zone, cx, cy)) SELECT event_id, arg_min(zone, sqrt((x - cx) ** 2 + (y - cy) ** 2) * 1000 + zone / 1000.0)::INT AS zone FROM det, z GROUP BY event_id")
def jn17(spark, sf):
    rows = detections(spark, sf).select("event_id", "camera_id", "x", "y")
    spots = F.array(*[F.struct(F.lit(k).alias("zone"), F.lit(a).alias("cx"), F.lit(b).alias("cy")) for k, a, b in ((0, 50.0, 50.0), (1, 300.0, 60.0), (2, 200.0, 250.0))])
    zones = rows.select("camera_id").distinct().select("camera_id", F.inline(spots))
    return scoring.nearest_zone(rows, zones).select("event_id", "zone")


@query("gra02_components", "WITH RECURSIVE " + PAIRS + ", b AS (SELECT i, j FROM edges UNION SELECT j, i FROM edges), w AS (SELECT i AS node, i AS reach FROM b UNION SELECT w.node, b.j FROM w JOIN b ON w.reach = b.i) SELECT node, min(reach) AS component FROM w GROUP BY node")
def gra02(spark, sf):
    return components(edges(spark, sf).select(F.col("i").alias("a"), F.col("j").alias("b")))


@query("gra01_threshold_clusters", "WITH RECURSIVE " + PAIRS + ", e AS (SELECT i, j FROM edges WHERE sim >= 0.3), b AS (SELECT i, j FROM e UNION SELECT j, i FROM e), w AS (SELECT index_id AS node, index_id AS reach FROM feat UNION SELECT w.node, b.j FROM w JOIN b ON w.reach = b.i) SELECT node, min(reach) AS cluster FROM w GROUP BY node")
def gra01(spark, sf):
    nodes = features(spark, sf).select(F.col("index_id").alias("node"))
    return graphs.threshold_clusters(nodes, edges(spark, sf), 0.3)


def _nodes(spark, sf):
    return features(spark, sf).select(F.col("index_id").alias("node"), "camera_id", (F.col("index_id") % 24).cast("double").alias("start"), (F.col("index_id") % 24 + 3).cast("double").alias("end"))


@query("gra03_without_weak_bridges", "WITH RECURSIVE " + PAIRS + ", b AS (SELECT i, j FROM edges UNION ALL SELECT j, i FROM edges), wk AS (SELECT i, j FROM edges WHERE sim < 0.27), r AS (SELECT i AS wi, j AS wj, i AS node FROM wk UNION SELECT r.wi, r.wj, b.j FROM r JOIN b ON b.i = r.node WHERE NOT (b.i = r.wi AND b.j = r.wj) AND NOT (b.i = r.wj AND b.j = r.wi)), cut AS (SELECT i, j FROM wk WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.wi = wk.i AND r.wj = wk.j AND r.node = wk.j)) SELECT e.i, e.j, round(sim, 6) AS sim FROM edges e LEFT JOIN cut ON cut.i = e.i AND cut.j = e.j WHERE cut.i IS NULL")
def gra03(spark, sf):
    return _round(graphs.without_weak_bridges(edges(spark, sf), 0.25, 0.02), "sim")


_SPANS = "nd AS (SELECT index_id AS n, camera_id AS cam, (index_id % 24)::DOUBLE AS s, (index_id % 24 + 3)::DOUBLE AS e FROM feat)"


@query("gra04_conflict_free", "WITH RECURSIVE " + PAIRS + f", {_SPANS}" + ", o AS (SELECT i, j, row_number() OVER (ORDER BY sim DESC, i, j) AS k FROM edges), g AS (SELECT 0::BIGINT AS k, list({'n': n, 'c': n, 'cam': cam, 's': s, 'e': e} ORDER BY n) AS st FROM nd UNION ALL SELECT q.k, CASE WHEN ci = cj OR len(list_filter(q.a, lambda x: len(list_filter(q.b, lambda y: x.cam = y.cam AND x.s <= y.e AND y.s <= x.e)) > 0)) > 0 THEN q.st ELSE list_transform(q.st, lambda x: {'n': x.n, 'c': CASE WHEN x.c = ci OR x.c = cj THEN least(ci, cj) ELSE x.c END, 'cam': x.cam, 's': x.s, 'e': x.e}) END FROM (SELECT p.*, list_filter(st, lambda x: x.c = ci) AS a, list_filter(st, lambda x: x.c = cj) AS b FROM (SELECT o.k, g.st, list_filter(g.st, lambda x: x.n = o.i)[1].c AS ci, list_filter(g.st, lambda x: x.n = o.j)[1].c AS cj FROM g JOIN o ON o.k = g.k + 1) p) q), z AS (SELECT unnest(st) AS u FROM g WHERE k = (SELECT max(k) FROM g)) SELECT u.n AS node, u.c AS cluster FROM z")
def gra04(spark, sf):
    return graphs.conflict_free_clusters(_nodes(spark, sf), edges(spark, sf), 0.25)


@query("gra06_communities")
def gra06(spark, sf):
    return communities.louvain_clusters(_nodes(spark, sf), edges(spark, sf), 0.25)


@query("gra07_complete_linkage")
def gra07(spark, sf):
    return graphs.complete_linkage_clusters(_nodes(spark, sf), edges(spark, sf), 0.25)


@query("gra08_capped")
def gra08(spark, sf):
    return graphs.capped_clusters(_nodes(spark, sf), edges(spark, sf), 0.25, 8)


@query("gra09_coloured", "WITH RECURSIVE " + PAIRS + f", {_SPANS}" + ", b AS (SELECT i, j FROM edges UNION SELECT j, i FROM edges), w AS (SELECT n AS node, n AS reach FROM nd UNION SELECT w.node, b.j FROM w JOIN b ON w.reach = b.i), c AS (SELECT node, min(reach) AS cluster FROM w GROUP BY node), o AS (SELECT node, cluster, cam, s, e, row_number() OVER (PARTITION BY cluster ORDER BY node % 5 DESC, node) AS r FROM c JOIN nd ON nd.n = c.node), h AS (SELECT cluster, r, [{'n': node, 'p': 0::BIGINT, 'cam': cam, 's': s, 'e': e}] AS held FROM o WHERE r = 1 UNION ALL SELECT o.cluster, o.r, list_append(h.held, {'n': o.node, 'p': list_min(list_filter(range(0, len(h.held) + 1), lambda k: len(list_filter(h.held, lambda x: x.p = k AND x.cam = o.cam AND x.s <= o.e AND o.s <= x.e)) = 0)), 'cam': o.cam, 's': o.s, 'e': o.e}) FROM h JOIN o ON o.cluster = h.cluster AND o.r = h.r + 1), f AS (SELECT cluster, held FROM h QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY r DESC) = 1), z AS (SELECT cluster, unnest(held) AS u FROM f) SELECT u.n AS node, cluster, u.p AS part FROM z")
def gra09(spark, sf):
    nodes = _nodes(spark, sf)
    clusters = graphs.threshold_clusters(nodes, edges(spark, sf), 0.25)
    return graphs.coloured_clusters(nodes.join(clusters, "node").withColumn("strength", (F.col("node") % 5).cast("double")))


@query("gra12_verified", "WITH RECURSIVE " + PAIRS + ", b AS (SELECT i, j FROM edges UNION SELECT j, i FROM edges), w AS (SELECT index_id AS node, index_id AS reach FROM feat UNION SELECT w.node, b.j FROM w JOIN b ON w.reach = b.i), c AS (SELECT node, min(reach) AS cluster FROM w GROUP BY node), z AS (SELECT cluster, count(*) AS n FROM c GROUP BY cluster), t AS (SELECT i AS node, sim FROM edges UNION ALL SELECT j, sim FROM edges), m AS (SELECT node, max(sim) AS best FROM t GROUP BY node) SELECT node, CASE WHEN n > 2 AND coalesce(best, -1) < 0.3 THEN -1 - node ELSE cluster END AS cluster FROM c JOIN z USING (cluster) LEFT JOIN m USING (node)")
def gra12(spark, sf):
    nodes = features(spark, sf).select(F.col("index_id").alias("node"))
    e = edges(spark, sf).select("i", "j", "sim")
    return graphs.verified_clusters(graphs.threshold_clusters(nodes, e, 0.25), e, 0.3)


@query("agg15_cluster_confidence", "WITH RECURSIVE " + PAIRS + ", e AS (SELECT * FROM edges WHERE sim >= 0.3), b AS (SELECT i, j FROM e UNION SELECT j, i FROM e), w AS (SELECT index_id AS node, index_id AS reach FROM feat UNION SELECT w.node, b.j FROM w JOIN b ON w.reach = b.i), c AS (SELECT node, min(reach) AS cluster FROM w GROUP BY node), s AS (SELECT cluster, count(*) AS size FROM c GROUP BY cluster), m AS (SELECT x.cluster, avg(e.sim) AS mean FROM edges e JOIN c x ON x.node = e.i JOIN c y ON y.node = e.j AND y.cluster = x.cluster GROUP BY x.cluster) SELECT cluster, size, round(CASE WHEN size = 1 THEN 1 ELSE greatest(0, coalesce(mean, 0)) END, 6) AS confidence FROM s LEFT JOIN m USING (cluster)")
def agg15(spark, sf):
    nodes = features(spark, sf).select(F.col("index_id").alias("node"))
    e = edges(spark, sf).select("i", "j", "sim")
    return _round(graphs.cluster_confidence(graphs.threshold_clusters(nodes, e, 0.3), e), "confidence")


#: Probes: a stated query set, every row whose id is divisible by 50.
PROBES = FT + ", p AS (SELECT index_id AS probe_id, v, class_id FROM feat WHERE index_id % 50 = 0), c AS (SELECT p.probe_id, f.index_id, f.camera_id, f.pid, list_inner_product(p.v, f.v) AS sim FROM p, feat f) "


def _probes(spark, sf):
    return features(spark, sf).where("index_id % 50 = 0")


@query("top02_query_by_vector", PROBES + "SELECT probe_id, index_id, round(sim, 6) AS sim, row_number() OVER (PARTITION BY probe_id ORDER BY sim DESC, index_id) AS place FROM c WHERE sim >= 0.1 AND probe_id <> index_id QUALIFY place <= 10")
def top02(spark, sf):
    out = search.top_matches(_probes(spark, sf), features(spark, sf), 10, 0.1, exclude_self=True)
    return _round(out, "sim").withColumn("place", F.col("place").cast("long"))


@query("top03_track_search", PROBES + ", b AS (SELECT probe_id, pid, max(sim) AS best FROM c GROUP BY ALL), s AS (SELECT pid, avg(best) AS score FROM b GROUP BY pid) SELECT pid, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, pid) AS place FROM s QUALIFY place <= 20")
def top03(spark, sf):
    return _round(search.track_search(_probes(spark, sf), features(spark, sf), "pid", 20), "score").withColumn("place", F.col("place").cast("long"))


@query("vec23_trajectory_scores", PROBES + ", b AS (SELECT probe_id, pid, max(sim) AS best FROM c GROUP BY ALL) SELECT pid, round(avg(best), 6) AS mean, round(quantile_cont(best, 0.25), 6) AS p25 FROM b GROUP BY pid HAVING avg(best) >= 0.2 AND quantile_cont(best, 0.25) >= 0.12")
def vec23(spark, sf):
    return _round(search.trajectory_scores(_probes(spark, sf), features(spark, sf), "pid", 0.2, 0.12), "mean", "p25")


@query("jn21_watchlist", PROBES + ", b AS (SELECT probe_id, pid, max(sim) AS best FROM c GROUP BY ALL) SELECT probe_id, pid, round(best, 6) AS best, CASE WHEN best * 0.9 >= 0.6 THEN 'HIGH' WHEN best * 0.9 >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM b WHERE best >= 0.3")
def jn21(spark, sf):
    return _round(search.watchlist_hits(_probes(spark, sf), features(spark, sf), "pid", 0.3, 0.9), "best")


@query("win11_average_precision", PROBES + ", r AS (SELECT c.probe_id, c.index_id, c.sim, f.class_id = c.index_id % 3 AS hit FROM c JOIN feat f ON f.index_id = c.probe_id WHERE c.index_id <> c.probe_id AND f.camera_id <> c.camera_id), k AS (SELECT *, row_number() OVER w AS place, sum(hit::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hits FROM r WINDOW w AS (PARTITION BY probe_id ORDER BY sim DESC, index_id)) SELECT probe_id AS query_id, round(avg(hits / place::DOUBLE), 6) AS ap, min(place) AS first_hit, count(*) AS n_positive FROM k WHERE hit GROUP BY probe_id")
def win11(spark, sf):
    return _round(evaluation.average_precision(_ranked(spark, sf)), "ap").withColumn("first_hit", F.col("first_hit").cast("long"))


def _ranked(spark, sf):
    """Every gallery row for each probe of the stated query set, of another camera; a match has the class."""
    rows = features(spark, sf)
    found = search.all_matches(_probes(spark, sf), rows, exclude_self=True)
    a = rows.select(F.col("index_id").alias("probe_id"), F.col("camera_id").alias("own"), F.col("class_id").alias("own_class"))
    b = rows.select("index_id", "camera_id", "class_id")
    joined = found.join(a, "probe_id").join(b, "index_id").where("own <> camera_id")
    return joined.select(F.col("probe_id").alias("query_id"), F.col("index_id").alias("gallery_id"), F.col("sim").alias("score"), (F.col("own_class") == F.col("class_id")).alias("is_match"))


@query("evl06_cmc", PROBES + ", r AS (SELECT c.probe_id, c.index_id, c.sim, f.class_id = c.index_id % 3 AS hit FROM c JOIN feat f ON f.index_id = c.probe_id WHERE c.index_id <> c.probe_id AND f.camera_id <> c.camera_id), k AS (SELECT *, row_number() OVER w AS place, sum(hit::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hits FROM r WINDOW w AS (PARTITION BY probe_id ORDER BY sim DESC, index_id)), a AS (SELECT probe_id, avg(hits / place::DOUBLE) AS ap, min(place) AS f FROM k WHERE hit GROUP BY probe_id) SELECT round(avg(ap), 6) AS map, round(avg((f <= 1)::INT), 6) AS r1, round(avg((f <= 5)::INT), 6) AS r5, round(avg((f <= 10)::INT), 6) AS r10, count(*) AS n_queries FROM a")
def evl06(spark, sf):
    return _round(evaluation.cmc(evaluation.average_precision(_ranked(spark, sf))), "map", "r1", "r5", "r10")


@query("agg30_threshold_sweep", PR + ", t AS (SELECT unnest([0.2, 0.25, 0.3, 0.35])::DOUBLE AS threshold), p AS (SELECT sim, pid_i % 5 = pid_j % 5 AS same FROM pairs WHERE sim >= 0.15), c AS (SELECT threshold, count(*) FILTER (sim >= threshold AND same) AS tp, count(*) FILTER (sim >= threshold AND NOT same) AS fp, count(*) FILTER (sim < threshold AND same) AS fn FROM p, t GROUP BY threshold) SELECT threshold, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c")
def agg30(spark, sf):
    pairs = edges(spark, sf, 0.15).select("sim", (F.col("pid_i") % 5 == F.col("pid_j") % 5).alias("same"))
    return _round(evaluation.threshold_sweep(pairs, [0.2, 0.25, 0.3, 0.35]), "precision", "recall", "f1")


@query("agg29_similarity_quantiles", PR + CAMS + ", l AS (SELECT cam_a, cam_b, list(score ORDER BY score) AS s FROM s GROUP BY ALL) SELECT cam_a, cam_b, len(s) AS n, round(s[len(s) // 4 + 1], 6) AS q1, round(s[len(s) // 2 + 1], 6) AS q2, round(s[3 * len(s) // 4 + 1], 6) AS q3 FROM l")
def agg29(spark, sf):
    rows = _scores(spark, sf).withColumns({"cam_a": F.least("camera_i", "camera_j"), "cam_b": F.greatest("camera_i", "camera_j")})
    w = Window.partitionBy("cam_a", "cam_b")
    placed = rows.withColumns({"n": F.count("*").over(w), "r": F.row_number().over(w.orderBy("score"))})

    def at(k: int, name: str):
        return F.round(F.max(F.when(F.col("r") == F.floor(F.col("n") * k / 4) + 1, F.col("score"))), 6).alias(name)

    return placed.groupBy("cam_a", "cam_b", "n").agg(at(1, "q1"), at(2, "q2"), at(3, "q3"))


@query("agg35_spearman", PR + ", r AS (SELECT class_id, rank() OVER (PARTITION BY class_id ORDER BY round(sim, 6)) + (count(*) OVER (PARTITION BY class_id, round(sim, 6)) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY class_id ORDER BY abs(i - j)) + (count(*) OVER (PARTITION BY class_id, abs(i - j)) - 1) / 2.0::DOUBLE AS ry FROM edges) SELECT class_id, round(corr(rx, ry), 6) AS rho FROM r GROUP BY class_id")
def agg35(spark, sf):
    rows = edges(spark, sf).withColumns({"a": F.round("sim", 6), "b": F.abs(F.col("i") - F.col("j"))})
    return _round(evaluation.spearman(rows, "class_id", "a", "b"), "rho")


GT = DT + ", p AS (SELECT camera_id, frame_id, track_id, x, y, w, h FROM det WHERE event_id % 2 = 0), g AS (SELECT camera_id, frame_id, track_id + 1000 AS track_id, x + 3 AS x, y + 2 AS y, w, h FROM det WHERE event_id % 3 <> 0), o AS (SELECT p.camera_id, p.frame_id, p.track_id AS pred_id, g.track_id AS gt_id, greatest(0, least(p.x + p.w, g.x + g.w) - greatest(p.x, g.x)) * greatest(0, least(p.y + p.h, g.y + g.h) - greatest(p.y, g.y)) AS a, p.w * p.h + g.w * g.h AS t FROM p JOIN g USING (camera_id, frame_id)), m AS (SELECT camera_id, frame_id, pred_id, gt_id, a / greatest(t - a, 1e-6) AS iou FROM o WHERE a / greatest(t - a, 1e-6) >= 0.3) "


def _boxes(spark, sf):
    rows = detections(spark, sf).select("event_id", "camera_id", "frame_id", "track_id", "x", "y", "w", "h")
    truth = rows.where("event_id % 3 <> 0").withColumns({"track_id": F.col("track_id") + 1000, "x": F.col("x") + 3, "y": F.col("y") + 2})
    return rows.where("event_id % 2 = 0").drop("event_id"), truth.drop("event_id")


@query("jn09_box_matches", GT + "SELECT camera_id, frame_id, pred_id, gt_id, round(iou, 6) AS iou FROM m")
def jn09(spark, sf):
    return _round(evaluation.box_matches(*_boxes(spark, sf), 0.3), "iou")


@query("jn10_voted_identity", GT + ", b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY camera_id, frame_id, pred_id ORDER BY iou DESC, gt_id) = 1), v AS (SELECT camera_id, pred_id, gt_id, count(*) AS votes FROM b GROUP BY ALL) SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY camera_id, pred_id ORDER BY votes DESC, gt_id) = 1")
def jn10(spark, sf):
    return evaluation.voted_identity(evaluation.box_matches(*_boxes(spark, sf), 0.3))


@query("agg32_fragmentation", GT + ", a AS (SELECT gt_id, count(DISTINCT pred_id) AS n FROM m GROUP BY gt_id), b AS (SELECT pred_id, count(DISTINCT gt_id) AS n FROM m GROUP BY pred_id) SELECT (SELECT count(*) FROM a WHERE n > 1) AS fragmented_gt, (SELECT count(*) FROM a) AS matched_gt, (SELECT count(*) FROM b WHERE n > 1) AS conflated_pred, (SELECT count(*) FROM b) AS matched_pred")
def agg32(spark, sf):
    return evaluation.fragmentation(evaluation.box_matches(*_boxes(spark, sf), 0.3))


@query("evl02_identity_scores")
def evl02(spark, sf):
    return _round(evaluation.identity_scores(*_boxes(spark, sf), 0.3), "idf1")


@query("evl03_global_identity_scores")
def evl03(spark, sf):
    return _round(evaluation.global_identity_scores(*_boxes(spark, sf), 0.3), "idf1")


@query("evl08_class_free_matches", GT + "SELECT camera_id, count(*) AS n, round(sum(iou), 5) AS total FROM m GROUP BY camera_id")
def evl08(spark, sf):
    """Boxes of both sides get class 1 before they are matched by class, so classes don't matter."""
    rows, truth = _boxes(spark, sf)
    mine, theirs = rows.withColumn("class_id", F.lit(1)), truth.withColumn("class_id", F.lit(1))
    return evaluation.box_matches(mine, theirs, 0.3, by_class=True).groupBy("camera_id").agg(F.count("*").alias("n"), F.round(F.sum("iou"), 5).alias("total"))


@query("evl09_ablation", GT + "SELECT 'loose' AS variant, count(*) AS n, round(avg(iou), 6) AS mean FROM m UNION ALL SELECT 'medium', count(*), round(avg(iou), 6) FROM m WHERE iou >= 0.5 UNION ALL SELECT 'strict', count(*), round(avg(iou), 6) FROM m WHERE iou >= 0.7")
def evl09(spark, sf):
    rows, truth = _boxes(spark, sf)

    def row(least):
        return evaluation.box_matches(rows, truth, least).agg(F.count("*").alias("n"), F.round(F.avg("iou"), 6).alias("mean"))

    return evaluation.ablation({"loose": row(0.3), "medium": row(0.5), "strict": row(0.7)})


@query("evl05_ground_scores")
def evl05(spark, sf):
    rows, truth = _boxes(spark, sf)
    return _round(evaluation.ground_scores(rows, truth, 50.0), "moda", "precision", "recall")


@query("set04_never_matched", GT + "SELECT DISTINCT track_id AS gt_id FROM g WHERE track_id NOT IN (SELECT gt_id FROM m WHERE iou >= 0.89)")
def set04(spark, sf):
    rows, truth = _boxes(spark, sf)
    matched = evaluation.box_matches(rows, truth, 0.89)
    return truth.select(F.col("track_id").alias("gt_id")).distinct().join(matched.select("gt_id").distinct(), "gt_id", "left_anti")


@query("set01_frame_union", GT + "SELECT camera_id, frame_id FROM p UNION SELECT camera_id, frame_id FROM g")
def set01(spark, sf):
    rows, truth = _boxes(spark, sf)
    return rows.select("camera_id", "frame_id").union(truth.select("camera_id", "frame_id")).distinct()


@query("agg24_row_ratio", GT + ", a AS (SELECT camera_id, count(*) AS n_pred FROM p GROUP BY ALL), b AS (SELECT camera_id, count(*) AS n_gt FROM g GROUP BY ALL) SELECT camera_id, n_pred, n_gt, CASE WHEN n_pred / n_gt > 1.2 THEN 'HIGH' WHEN n_pred / n_gt < 0.8 THEN 'LOW' ELSE 'OK' END AS grade FROM a JOIN b USING (camera_id)")
def agg24(spark, sf):
    rows, truth = _boxes(spark, sf)
    a, b = rows.groupBy("camera_id").agg(F.count("*").alias("n_pred")), truth.groupBy("camera_id").agg(F.count("*").alias("n_gt"))
    ratio = F.col("n_pred") / F.col("n_gt")
    return a.join(b, "camera_id").withColumn("grade", F.when(ratio > 1.2, "HIGH").when(ratio < 0.8, "LOW").otherwise("OK"))


@query("geo01_iou_next", DT + ", n AS (SELECT *, lead(x) OVER q AS nx, lead(y) OVER q AS ny, lead(w) OVER q AS nw, lead(h) OVER q AS nh FROM det WINDOW q AS (PARTITION BY camera_id, track_id ORDER BY frame_id, event_id)), o AS (SELECT event_id, greatest(0, least(x + w, nx + nw) - greatest(x, nx)) * greatest(0, least(y + h, ny + nh) - greatest(y, ny)) AS a, w * h + nw * nh AS t FROM n WHERE nx IS NOT NULL) SELECT event_id, round(a / greatest(t - a, 1e-6), 6) AS iou FROM o")
def geo01(spark, sf):
    q = Window.partitionBy("camera_id", "track_id").orderBy("frame_id", "event_id")
    rows = detections(spark, sf).withColumns({f"n{c}": F.lead(c).over(q) for c in "xywh"}).where("nx is not null")
    return rows.select("event_id", F.round(iou_xywh(*[F.col(c) for c in "xywh"], *[F.col(f"n{c}") for c in "xywh"]), 6).alias("iou"))


@query("msc01_skyline", "SELECT o_orderkey FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_totalprice >= a.o_totalprice AND b.o_custkey >= a.o_custkey AND (b.o_totalprice > a.o_totalprice OR b.o_custkey > a.o_custkey))")
def msc01(spark, sf):
    return evaluation.skyline(table(spark, sf, "orders"), "o_totalprice", "o_custkey").select("o_orderkey")


@query("msc05_first_ids", FT + "SELECT index_id FROM feat QUALIFY dense_rank() OVER (ORDER BY pid) <= 10")
def msc05(spark, sf):
    rows = features(spark, sf)
    first = rows.select("pid").distinct().orderBy("pid").limit(10)
    return rows.join(F.broadcast(first), "pid", "left_semi").select("index_id")  # ten rows


@query("jn20_gallery_and_query", FT + ", u AS (SELECT index_id, class_id, v, CASE WHEN index_id % 2 = 1 THEN 'query_' || camera_id ELSE camera_id END AS camera_id FROM feat), s AS (SELECT *, regexp_extract(camera_id, '^(S\\d+)_', 1) AS scene FROM u) SELECT a.index_id AS i, b.index_id AS j, round(list_inner_product(a.v, b.v), 6) AS sim FROM s a JOIN s b ON a.class_id = b.class_id AND a.camera_id < b.camera_id AND (a.scene = b.scene OR a.scene = '' OR b.scene = '') WHERE list_inner_product(a.v, b.v) >= 0.25")
def jn20(spark, sf):
    """Gallery and query rows in one join: query cameras are named apart, so a camera's own rows meet too."""
    rows = features(spark, sf)
    named = F.when(F.col("index_id") % 2 == 1, F.concat(F.lit("query_"), "camera_id")).otherwise(F.col("camera_id"))
    return _round(simjoin.similar_pairs(rows.withColumn("camera_id", named), 0.25), "sim")


@query("agg28_truth_structure", FT + ", c AS (SELECT pid, count(DISTINCT camera_id) AS n FROM feat GROUP BY pid) SELECT n AS cameras, count(*) AS ids FROM c GROUP BY n")
def agg28(spark, sf):
    return features(spark, sf).groupBy("pid").agg(F.count_distinct("camera_id").alias("cameras")).groupBy("cameras").agg(F.count("*").alias("ids"))


@query("gra17_own_ids", FT + "SELECT index_id AS node, row_number() OVER (ORDER BY index_id) - 1 AS global_id FROM feat")
def gra17(spark, sf):
    # Places by range partitions: counts of earlier ranges are added, so no single task sorts all rows.
    rows = features(spark, sf).select(F.col("index_id").alias("node")).repartitionByRange(8, "node").sortWithinPartitions("node")
    rows = rows.withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33))
    w = Window.partitionBy("part")
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.withColumn("r", F.row_number().over(w.orderBy("node")) - 1).join(F.broadcast(before), "part").select("node", (F.col("before") + F.col("r")).alias("global_id"))


@query("agg36_rank1_agreement", PROBES + ", a AS (SELECT probe_id, index_id AS one FROM c WHERE probe_id <> index_id QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY sim DESC, index_id) = 1), h AS (SELECT p.probe_id, f.index_id, list_inner_product(p.v[1:32], f.v[1:32]) AS sim FROM p, feat f WHERE p.probe_id <> f.index_id), b AS (SELECT probe_id, index_id AS two FROM h QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY sim DESC, index_id) = 1) SELECT count(*) AS n, count(*) FILTER (one = two) AS agree FROM a JOIN b USING (probe_id)")
def agg36(spark, sf):
    rows = features(spark, sf)
    short = rows.withColumn("v", F.slice("v", 1, 32))
    a = search.top_matches(_probes(spark, sf), rows, 1, exclude_self=True).select("probe_id", F.col("index_id").alias("one"))
    b = search.top_matches(short.where("index_id % 50 = 0"), short, 1, exclude_self=True).select("probe_id", F.col("index_id").alias("two"))
    return a.join(b, "probe_id").agg(F.count("*").alias("n"), F.count_if(F.col("one") == F.col("two")).alias("agree"))


@query("agg33_pair_auc", PR + ", r AS (SELECT pid_i % 5 = pid_j % 5 AS same, rank() OVER (ORDER BY round(sim, 6)) + (count(*) OVER (PARTITION BY round(sim, 6)) - 1) / 2.0::DOUBLE AS r FROM edges), s AS (SELECT sum(r) FILTER (same) AS r, count(*) FILTER (same) AS p, count(*) FILTER (NOT same) AS n FROM r) SELECT round((r - p * (p + 1) / 2.0::DOUBLE) / (p * n), 6) AS auc, p AS positives, n AS negatives FROM s")
def agg33(spark, sf):
    rows = edges(spark, sf).select(F.round("sim", 6).alias("score"), (F.col("pid_i") % 5 == F.col("pid_j") % 5).alias("same"))
    return _round(evaluation.pair_auc(rows), "auc")


@query("win13_camera_map", PROBES + ", r AS (SELECT c.probe_id, c.sim, c.index_id, f.class_id = c.index_id % 3 AS hit, f.camera_id = c.camera_id AS own FROM c JOIN feat f ON f.index_id = c.probe_id WHERE c.index_id <> c.probe_id), k AS (SELECT *, row_number() OVER w AS place, sum(hit::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hits FROM r WINDOW w AS (PARTITION BY own, probe_id ORDER BY sim DESC, index_id)), a AS (SELECT own, probe_id, avg(hits / place::DOUBLE) AS ap FROM k WHERE hit GROUP BY ALL) SELECT own AS same_camera, round(avg(ap), 6) AS map, count(*) AS n_queries FROM a GROUP BY own")
def win13(spark, sf):
    rows = features(spark, sf)
    found = search.all_matches(_probes(spark, sf), rows, exclude_self=True)
    a = rows.select(F.col("index_id").alias("probe_id"), F.col("camera_id").alias("own"), F.col("class_id").alias("own_class"))
    joined = found.join(a, "probe_id").join(rows.select("index_id", "camera_id", "class_id"), "index_id")
    ranked = joined.select(
        F.struct((F.col("own") == F.col("camera_id")).alias("same"), "probe_id").alias("query_id"), F.col("index_id").alias("gallery_id"), F.col("sim").alias("score"),
        (F.col("own_class") == F.col("class_id")).alias("is_match"),
    )
    per_query = evaluation.average_precision(ranked)
    return per_query.groupBy(F.col("query_id.same").alias("same_camera")).agg(F.round(F.avg("ap"), 6).alias("map"), F.count("*").alias("n_queries"))


@query("msc04_query_gallery_split", FT + ", m AS (SELECT pid, count(DISTINCT camera_id) AS n FROM feat GROUP BY pid), q AS (SELECT f.index_id FROM feat f JOIN m USING (pid) WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY f.pid, f.camera_id ORDER BY (f.index_id * 7919) % 1009, f.index_id) = 1) SELECT f.index_id, CASE WHEN q.index_id IS NOT NULL THEN 'query' WHEN n >= 2 THEN 'gallery' ELSE 'distractor' END AS part FROM feat f JOIN m USING (pid) LEFT JOIN q ON q.index_id = f.index_id")
def msc04(spark, sf):
    rows = features(spark, sf)
    n = rows.groupBy("pid").agg(F.count_distinct("camera_id").alias("n"))
    w = Window.partitionBy("pid", "camera_id").orderBy((F.col("index_id") * 7919) % 1009, "index_id")
    placed = rows.join(n, "pid").withColumn("r", F.row_number().over(w))
    part = F.when(F.col("n") < 2, "distractor").when(F.col("r") == 1, "query").otherwise("gallery")
    return placed.select("index_id", part.alias("part"))


@query("agg20_topology_prior", FT + ", c AS (SELECT DISTINCT camera_id FROM feat) SELECT a.camera_id AS cam_a, b.camera_id AS cam_b, CASE WHEN left(a.camera_id, 3) = left(b.camera_id, 3) THEN 0.05 ELSE -0.2 END::DOUBLE AS bias FROM c a, c b WHERE a.camera_id <> b.camera_id")
def agg20(spark, sf):
    # Camera names are few; each is paired with the list of all names.
    cams = features(spark, sf).select("camera_id").distinct()
    names = cams.agg(F.collect_set("camera_id").alias("all")).withColumn("k", F.lit(1))
    pairs = cams.withColumn("k", F.lit(1)).join(F.broadcast(names), "k").select(F.col("camera_id").alias("cam_a"), F.explode("all").alias("cam_b")).where("cam_a <> cam_b")
    return pairs.withColumn("bias", F.when(F.substring("cam_a", 1, 3) == F.substring("cam_b", 1, 3), 0.05).otherwise(-0.2))


def _splits(rounds):
    """SQL of the given number of cutting rounds; the last of them cut nothing in the given tables."""
    sql = "m0 AS (SELECT index_id, pid AS cluster, (index_id % 400)::DOUBLE AS start, (index_id % 400 + 5)::DOUBLE AS stop, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM feat)"
    for k in range(1, rounds + 1):
        sql += (
            f", g{k} AS (SELECT *, start - max(stop) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap, row_number() OVER w AS place FROM m{k - 1} WINDOW w AS (PARTITION BY cluster ORDER BY start, stop, index_id))"
            f", x{k} AS (SELECT cluster, place AS cut FROM g{k} WHERE gap >= 40 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY gap DESC, place) = 1)"
            f", s{k} AS (SELECT g.*, place >= cut AS late FROM g{k} g JOIN x{k} USING (cluster))"
            f", a{k} AS (SELECT a.cluster FROM s{k} a JOIN s{k} b ON a.cluster = b.cluster AND NOT a.late AND b.late GROUP BY a.cluster HAVING avg(list_inner_product(a.v, b.v)) < 0.2)"
            f", f{k} AS (SELECT cluster, min(index_id) AS fresh FROM s{k} JOIN a{k} USING (cluster) WHERE late GROUP BY cluster)"
            f", m{k} AS (SELECT m.index_id, CASE WHEN s.late AND f.fresh IS NOT NULL THEN -1 - f.fresh ELSE m.cluster END AS cluster, m.start, m.stop, m.v FROM m{k - 1} m LEFT JOIN s{k} s USING (index_id) LEFT JOIN f{k} f ON f.cluster = m.cluster)"
        )
    return sql + f" SELECT index_id, cluster FROM m{rounds}"


@query("win05_temporal_split", FT + ", " + _splits(12))
def win05(spark, sf):
    rows = features(spark, sf).select("index_id", F.col("pid").alias("cluster"), (F.col("index_id") % 400).cast("double").alias("start"), (F.col("index_id") % 400 + 5).cast("double").alias("end"), "v")
    return trajectories.temporal_split(rows, 40.0, 0.2)


@query("jn04_multi_query_pairs", PR + ", m AS (SELECT p.i, p.j, 0.5 * p.sim + 0.5 * greatest(list_inner_product(a.v, b.v), list_inner_product(list_reverse(a.v), b.v), list_inner_product(a.v, list_reverse(b.v))) AS sim FROM pairs p JOIN feat a ON a.index_id = p.i JOIN feat b ON b.index_id = p.j) SELECT i, j, round(sim, 6) AS sim FROM m WHERE sim >= 0.25")
def jn04(spark, sf):
    rows = features(spark, sf).withColumn("queries", F.array("v", F.reverse("v")))
    return _round(simjoin.multi_query_pairs(rows, 0.25, 0.5), "sim")


def _members(spark, sf):
    """Clusters of edges from 0.3 on, with what expansion looks at; colours are the sizes of leading entries."""
    rows = features(spark, sf).select(
        F.col("index_id").alias("node"), "camera_id", "class_id", (F.col("index_id") % 240).cast("double").alias("start"), (F.col("index_id") % 240 + 3).cast("double").alias("end"),
        V.normalized("v").alias("v"), V.normalized(F.transform(F.slice("v", 1, 16), lambda x: F.abs(x))).alias("color"),
    )
    return rows.join(graphs.threshold_clusters(rows.select("node"), edges(spark, sf).select("i", "j", "sim"), 0.3), "node")


@query("gra05_verified_merges")
def gra05(spark, sf):
    return expansion.verified_merges(_nodes(spark, sf), edges(spark, sf).select("i", "j", "sim"), 0.25)


@query("gra10_hierarchical")
def gra10(spark, sf):
    gates = expansion.Gates(low=0.0, high=200.0, color=0.6, size=12)
    return expansion.hierarchically_expanded(_members(spark, sf), edges(spark, sf).select("i", "j", "sim"), 0.22, 0.2, 0.27, 0.01, gates)


@query("gra11_expanded")
def gra11(spark, sf):
    gates = expansion.Gates(low=0.0, high=200.0, color=0.6)
    return expansion.gallery_expanded(_members(spark, sf), edges(spark, sf).select("i", "j", "sim"), 0.26, 2, 0.25, 0.01, 8, gates)


@query("gra13_linked_trajectories")
def gra13(spark, sf):
    rows = chopped(spark, sf).withColumn("class_id", F.col("track_id") % 3)
    number = F.col("track_id") * 10 + F.substring("camera_id", 4, 1).cast("long")
    return trajectories.linked_until_stable(rows.withColumn("track_id", number), 12, 200.0, 0.5, 0.2)


@query("evl04_hota_scores")
def evl04(spark, sf):
    return _round(trajectories.box_hota_scores(*_boxes(spark, sf), 1e-6), "hota", "det_a", "ass_a")
