"""Limits and ties that the order of a sum, a last bit or a large id used to decide."""

import math
import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from trackloom.operators import evaluation, graphs, reports, scoring, search, simjoin
from trackloom.operators import tracklets as T
from trackloom.operators import trajectories
from trackloom.operators.components import components


def test_mean_at_the_limit(spark):
    rows = spark.range(10).select(F.lit("c").alias("camera_id"), F.lit(1).alias("track_id"), F.col("id").alias("frame_id"), F.lit(0.1).alias("confidence")).coalesce(1)
    assert T.drop_reasons(T.tracklet_stats(rows), 5, 0.1).first()["reason"] is None
    level = spark.range(10).select(F.lit(0.12).alias("c")).coalesce(1).agg(F.avg("c").alias("c")).select(scoring.alert_level(F.col("c"), F.lit(5.0)).alias("level"))
    assert level.first()["level"] == "HIGH"


def against_sql(spark, folder, name, tables):
    duck = duckdb.connect()
    for t in tables:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = entry.queries()[name](spark, str(folder))
    want = duck.execute(f"SELECT {', '.join(found.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert want and sorted(map(tuple, found.collect())) == sorted(want)


@pytest.mark.parametrize("name, table, change", [
    ("msc02_sensitivity", "lineitem", "l_orderkey + k * 10000000 AS l_orderkey"),
    ("jn19_motion_links", "events", "event_id + k * 10000000001 AS event_id"),
])
def test_repeated_tables(spark, tmp_path, name, table, change):
    duckdb.sql(f"COPY (SELECT * REPLACE ({change}) FROM '/root/testdata/sf0.01/{table}.parquet', range(3) t(k)) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    against_sql(spark, tmp_path, name, [table])


def test_merged_ground_points_of_any_shape(spark):
    """Random, repeated and odd points against all pairs; cells above each other are tied by inner places too."""
    rng = random.Random(3)
    points = [(f, rng.randrange(4), round(rng.uniform(-40, 40), rng.choice([0, 1, 6])), float(rng.randrange(-40, 40))) for f in range(12) for _ in range(3 + 3 * f)]
    points += points[:20] + [(50, 1, 0.0, 0.0), (50, 2, 3.0, 0.0), (50, 2, 6.0, 0.0), (50, 3, 3.0, 9.9), (51, 1, None, 1.0), (51, 2, None, 1.0), (51, 3, float("nan"), 1.0), (51, 4, float("inf"), 1.0), (None, 5, 1.0, 1.0), (None, 6, 1.0, 1.0)]
    root = list(range(len(points)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(points):
        for j, b in enumerate(points[:i]):
            if a == b or (a[0] == b[0] and None not in a + b and math.hypot(a[2] - b[2], a[3] - b[3]) <= 10):
                root[find(i)] = find(j)
    groups = {}
    for k, p in enumerate(points):
        groups.setdefault(find(k), []).append(p)
    want = []
    for own in groups.values():
        if own[0][0] is None:  # as in the SQL, rows without a frame go
            continue
        ids = [p[1] for p in own]
        mean = [None if any(p[c] is None for p in own) else sum(p[c] for p in own) / len(own) for c in (2, 3)]
        want.append((own[0][0], min(ids, key=lambda i: (-ids.count(i), i)), *mean))
    frame = spark.createDataFrame(points, "frame_id long, track_id long, x double, y double")
    got = [tuple(r) for r in trajectories.merged_ground_points(frame, 10.0).collect()]

    def shown(rows):
        return sorted(str(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)

    assert shown(got) == shown(want)


def test_merged_ground_points_count_places_once(spark, monkeypatch):
    """Points that stand at few places are compared as places: edges don't grow with the rows."""
    edges = []
    monkeypatch.setattr(trajectories, "components", lambda e: edges.append(e.count()) or components(e))
    for n in (1000, 3000):
        frame = spark.range(n).select(F.lit(1).cast("long").alias("frame_id"), F.col("id").alias("track_id"), (F.col("id") % 50).cast("double").alias("x"), (F.col("id") % 20).cast("double").alias("y"))
        trajectories.merged_ground_points(frame, 10.0).collect()
    assert edges[0] == edges[1]


def test_long_timeline(spark):
    """40,000 steps of 10,000 names in one trajectory; looking for each step among the others took minutes."""
    step = lambda k: F.struct(F.when(k % 4 == 3, "query_c").otherwise(F.lit("c")).alias("camera_id"), (k % 10000).alias("track_id"), k.alias("at"))
    rows = spark.range(1).select(F.lit(7).alias("global_id"), F.transform(F.sequence(F.lit(0), F.lit(39999)), step).alias("timeline"))
    odd = spark.range(2).select((F.col("id") + 8).cast("int").alias("global_id"), F.when(F.col("id") == 0, F.slice(F.transform(F.array(F.lit(3)), step), 1, 1)).alias("timeline"))
    start = time.monotonic()
    found = {r.global_id: r.timeline for r in reports.cleaned_timelines(rows.unionByName(odd)).collect()}
    assert time.monotonic() - start < 40
    assert [s.at for s in found[7]] == [k for k in range(10000) if k % 4 < 3] and found[8] == [] and found[9] is None


def test_best_of_copies():
    """Copies whose products differ in the last bit tie and go by id, whatever the parts they come in."""
    rng = np.random.default_rng(5)
    sims = np.repeat(rng.uniform(-1, 1, (4, 30)), 7, axis=1)
    ids, noisy = rng.permutation(210), sims + rng.uniform(-1e-15, 1e-15, sims.shape)
    noisy[3, 5:] = -np.inf
    best = search.Best(4, 12)
    for k in range(0, 210, 25):
        best.add(0, noisy[:2, k : k + 25].copy(), ids[k : k + 25])
        best.add(2, noisy[2:, k : k + 25].copy(), ids[k : k + 25])
    row, found, _ = best.table(np.arange(4))
    for r in range(4):
        every = [(-sims[r, c], ids[c]) for c in range(210) if noisy[r, c] > -np.inf]
        assert found[row == r].tolist() == [i for _, i in sorted(every)[:12]]


def test_nearest_in_blocks(spark, monkeypatch):
    """k rows for each row leave the tasks, not k for each pair of blocks; rows without a scene meet all scenes."""
    m = np.random.default_rng(2).standard_normal((40, 4))
    m = np.concatenate([m, m])
    camera = [("S01_c0", "S01_c1", "S02_c1", "q", "r")[k % 5] for k in range(80)]
    rows = spark.createDataFrame([(k, camera[k], k % 2, m[k].tolist()) for k in range(80)], "index_id long, camera_id string, class_id int, v array<double>")
    monkeypatch.setattr(simjoin, "SMALL", 0)
    monkeypatch.setattr(simjoin._best_in_blocks, "__defaults__", (7,))
    scene = [c[:3] if c[0] == "S" else "" for c in camera]
    for frame, fits in ((rows, lambda i, j: camera[i] != camera[j] and i % 2 == j % 2 and (scene[i] == scene[j] or not scene[i] or not scene[j])), (None, lambda i, j: i != j)):
        found = simjoin.nearest(rows, 3) if frame else simjoin.plain_neighbours(rows, 3)
        got = sorted((r.i, r.place, r.j) for r in found.collect())
        order = lambda i: sorted((j for j in range(80) if fits(i, j)), key=lambda j: (-round(float(m[i] @ m[j]), 9), j))[:3]  # noqa: E731, B023
        assert got == [(i, p + 1, j) for i in range(80) for p, j in enumerate(order(i))]
    plain = rows.select("index_id", F.col("index_id").cast("string").alias("camera_id"), F.lit(0).alias("class_id"), "v")
    assert simjoin._best_in_blocks(plain, 3).count() == 240


@pytest.mark.parametrize("name", ["vec17_model_fusion", "msc10_blended_scores"])
def test_scores_of_a_pair_are_not_shuffled(spark, name):
    assert "Exchange" not in entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [simjoin.BLOCK, 7])
def test_pairs_are_counted_where_they_are_made(spark, monkeypatch, block):
    monkeypatch.setattr(simjoin, "NEAR_BLOCKS", 4)
    m = np.random.default_rng(4).standard_normal((90, 4))
    camera = [("S01_c0", "S01_c1", "S02_c1", "S02_c2", "q", "r")[(k // 2) % 6] for k in range(90)]
    rows = spark.createDataFrame([(k, camera[k], k % 2, m[k].tolist(), k % 5) for k in range(90)], "index_id long, camera_id string, class_id int, v array<double>, label int")
    pairs = [r for r in simjoin.similar_pairs(rows, -1e9).collect() if r.i % 5 == r.j % 5]
    want = [len(pairs), sum(r.sim >= 0.5 for r in pairs), sum(r.sim >= 2.0 for r in pairs)]
    assert want[2] > 0 and list(simjoin.pair_counts(rows, "label", [0.5, 2.0], block).first()) == want


def test_most_in_common_holds_pairs_only(spark, monkeypatch):
    """Random pairs against the dense table, with and without rounds of sure pairs; 10,000 ids in one ring of equal pairs, whose
    dense table would take 200 MB."""
    rng = random.Random(8)
    for _ in range(60):
        n, m = rng.randrange(1, 9), rng.randrange(1, 9)
        table = np.array([[rng.choice([0, 0, 1, 1, 2, 5]) for _ in range(m)] for _ in range(n)])
        a, b = np.nonzero(table)
        want = sum(table[i, j] for i, j in evaluation.best_assignment(-table))
        assert evaluation.most_weight(a.tolist(), b.tolist(), table[a, b].tolist()) == want
    ring = [(0, k, (k + s) % 5000, 1) for k in range(5000) for s in (0, 1)]
    some = [(c, rng.randrange(40), rng.randrange(40), rng.choice([1, 1, 2, 7])) for c in range(1, 5) for _ in range(90)]
    some = list({r[:3]: r for r in some}.values())
    rows = ring + some
    frame = spark.createDataFrame(rows, "camera_id int, gt_id long, pred_id long, n long")
    want = {0: 5000}
    for c in range(1, 5):
        table = np.zeros((40, 40), dtype=int)
        for _, g, p, n in (r for r in some if r[0] == c):
            table[g, p] = n
        want[c] = int(sum(table[i, j] for i, j in evaluation.best_assignment(-table)))
    for limit in (1 << 20, 10):
        monkeypatch.setattr(evaluation, "GROUP_PAIRS", limit)
        assert {r.camera_id: r.idtp for r in evaluation.most_in_common(frame, ["camera_id"]).collect()} == want
    copies = spark.createDataFrame([(0, g, p, 4 if g // 3 == p // 3 else 2) for g in range(30) for p in range(30) if g // 3 == p // 3 or (g + p) % 4 == 0], "camera_id int, gt_id long, pred_id long, n long")
    assert sorted(r.idtp for r in evaluation.sure_blocks(copies, ["camera_id"]).collect()) == [12] * 10


@pytest.mark.parametrize("block, frames", [(2048, 9), (7, 9), (7, 400)])
def test_shared_frames_are_counted_in_blocks(spark, monkeypatch, block, frames):
    """Rows that meet in one frame aren't joined: only tracks and their frames are shuffled."""
    rng = random.Random(9)
    monkeypatch.setattr(T, "TRACK_BLOCK", block)
    monkeypatch.setattr(T, "FRAME_STEP", 4)
    monkeypatch.setattr(T, "PAIR_STEP", 10)
    rows = [("ab"[rng.randrange(2)], rng.randrange(frames), rng.randrange(-20, 20)) for _ in range(500)] + [(None, 1, 1), ("a", None, 2), ("a", 1, None)]
    seen = {}
    for c, f, t in rows:
        if None not in (c, f, t):
            seen.setdefault(t, {}).setdefault(c, set()).add(f)
    want = [(a, b, sum(len(seen[a].get(c, set()) & seen[b].get(c, set())) >= 2 for c in "ab")) for a in seen for b in seen if a < b]
    found = T.shared_frames(spark.createDataFrame(rows, "camera_id string, frame_id long, track_id long"), 2)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted(r for r in want if r[2])


@pytest.mark.parametrize("pairs", [1 << 22, 60])
def test_hota_of_boxes(spark, monkeypatch, pairs):
    """The scores of all overlaps given one by one, which aren't joined any more; ids with several boxes in a frame, too."""
    monkeypatch.setattr(trajectories, "HOTA_PAIRS", pairs)
    rng = random.Random(6)
    sides = []
    for n in (14, 11):
        rows = [("ab"[rng.randrange(2)], rng.randrange(12), rng.randrange(n), *(rng.uniform(1, 60) for _ in range(4))) for _ in range(260)]
        sides.append(spark.createDataFrame(rows + [(None, 1, 1, 1.0, 1.0, 9.0, 9.0), ("a", None, 1, 1.0, 1.0, 9.0, 9.0)], "camera_id string, frame_id long, track_id long, x double, y double, w double, h double"))
    sides[1] = sides[1].unionByName(sides[0].where("camera_id = 'a'").limit(80))
    want = {r.camera_id: r for r in trajectories.hota_scores(evaluation.box_matches(*sides, 1e-6), *sides).collect()}
    found = trajectories.box_hota_scores(*sides, 1e-6)
    got = {r.camera_id: r for r in found.collect()}
    assert {"a", "b"} <= set(got) == set(want) and all(got[c][k] == pytest.approx(want[c][k], abs=1e-9) for c in want for k in ("hota", "det_a", "ass_a"))


def test_hota_joins_no_overlaps(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "box_matches", None)
    assert entry.queries()["evl04_hota_scores"](spark, "/root/testdata/sf0.001").count() == 4


def test_bridges_of_large_components(spark, monkeypatch):
    """No task holds a component's edges: two forests are enough, and any group limit is without effect."""
    monkeypatch.setattr(graphs, "MAX_GROUP_EDGES", 1)
    rng = random.Random(4)
    edges = [(a, b, rng.choice([0.5, 0.52, 0.7])) for base in (0, 100, 200) for a in range(base, base + 25) for b in range(a + 1, base + 25) if rng.random() < 0.8]
    edges += [(k, k + 100, 0.5 + k / 50) for k in (0, 3)] + [(124, 200, 0.51), (224, 300, 0.53), (300, 301, 0.9), (301, 302, 0.5), (301, 302, 0.5), (400, 401, 0.55)]
    frame = spark.createDataFrame(edges, "i long, j long, sim double").repartition(3)
    cut = graphs.bridges([e[:2] for e in edges])
    want = [e for k, e in enumerate(edges) if k not in cut or e[2] >= 0.6]
    assert len(want) == len(edges) - 3 and sorted(map(tuple, graphs.without_weak_bridges(frame, 0.5, 0.1).collect())) == sorted(want)
    forests = graphs.TwoForests()
    assert sum(forests.add(a, b) for a in range(200) for b in range(a)) <= 2 * 199
