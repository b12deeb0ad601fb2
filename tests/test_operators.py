"""Micro-cases and invariants of the operators that SQL can't express."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import geometry, names
from trackloom.functions import vectors as V
from trackloom.operators import evaluation, graphs, scoring, search, simjoin, trajectories
from trackloom.operators import tracklets as T
from trackloom.operators import vectors as P
from trackloom.operators.components import components
from trackloom.plans import retrieval_queries, vector_queries
from trackloom.sinks import tracking as sinks
from trackloom.sources import tracking as sources
from trackloom.streaming import sessions, trackers
from trackloom.tables import scratch_dir


def edges(spark, rows):
    return spark.createDataFrame(rows, "i long, j long, sim double")


def nodes(spark, n, camera=lambda k: f"c{k}", span=lambda k: (0.0, 1.0)):
    return spark.createDataFrame([(k, camera(k), *span(k)) for k in range(n)], "node long, camera_id string, start double, end double")


def clusters(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.cluster, set()).add(r.node)
    return sorted(map(sorted, out.values()))


def test_threshold_clusters(spark):
    e = edges(spark, [(0, 1, 0.9), (1, 2, 0.8), (3, 4, 0.9), (2, 3, 0.1)])
    assert clusters(graphs.threshold_clusters(nodes(spark, 6), e, 0.5)) == [[0, 1, 2], [3, 4], [5]]
    assert clusters(graphs.threshold_clusters(nodes(spark, 3), e, 0.95)) == [[0], [1], [2]]


def test_bridges():
    assert graphs.bridges([(0, 1), (1, 2), (2, 3)]) == {0, 1, 2}
    assert graphs.bridges([(0, 1), (1, 2), (2, 0), (2, 3)]) == {3}
    rng = random.Random(1)
    for _ in range(60):
        pairs = list({tuple(sorted(rng.sample(range(8), 2))) for _ in range(rng.randrange(1, 12))})

        def parts(own):
            root = {n: n for p in pairs for n in p}
            for a, b in own:
                x, y = a, b
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                root[x] = y
            return sum(root[n] == n for n in root)

        whole = parts(pairs)
        assert graphs.bridges(pairs) == {k for k in range(len(pairs)) if parts(pairs[:k] + pairs[k + 1 :]) > whole}


def test_weak_bridges(spark):
    e = edges(spark, [(0, 1, 0.9), (1, 2, 0.9), (0, 2, 0.9), (2, 3, 0.52), (3, 4, 0.9), (7, 8, 0.8)])
    kept = {(r.i, r.j) for r in graphs.without_weak_bridges(e, 0.5, 0.1).collect()}
    assert kept == {(0, 1), (1, 2), (0, 2), (3, 4), (7, 8)}


def test_conflict_free(spark):
    e = edges(spark, [(0, 1, 0.9), (1, 2, 0.8), (3, 4, 0.7)])
    same = nodes(spark, 5, lambda k: "c0" if k in (0, 2) else f"c{k}")
    assert clusters(graphs.conflict_free_clusters(same, e, 0.5)) == [[0, 1], [2], [3, 4]]
    later = nodes(spark, 5, lambda k: "c0", lambda k: (10.0 * k, 10.0 * k + 5))
    assert clusters(graphs.conflict_free_clusters(later, e, 0.5)) == [[0, 1, 2], [3, 4]]


def test_conflict_free_by_component_equals_whole_graph(spark):
    rng = random.Random(3)
    n = 40
    spans = [(float(rng.randrange(20)), 0.0) for _ in range(n)]
    cams = [f"c{rng.randrange(4)}" for _ in range(n)]
    rows = [(a, b, round(rng.uniform(0.3, 1), 3)) for a, b in {tuple(sorted(rng.sample(range(n), 2))) for _ in range(60)}]
    table = nodes(spark, n, lambda k: cams[k], lambda k: (spans[k][0], spans[k][0] + 3))
    group = {k: {k} for k in range(n)}
    for a, b, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        x, y = group[a], group[b]
        if s >= 0.5 and x is not y and not any(cams[p] == cams[q] and abs(spans[p][0] - spans[q][0]) <= 3 for p in x for q in y):
            x |= y
            for k in y:
                group[k] = x
    want = sorted(sorted(g) for g in {id(g): g for g in group.values()}.values())
    assert clusters(graphs.conflict_free_clusters(table, edges(spark, rows), 0.5)) == want


def test_complete_linkage(spark):
    chain = edges(spark, [(0, 1, 0.9), (1, 2, 0.8)])
    assert clusters(graphs.complete_linkage_clusters(nodes(spark, 3), chain, 0.5)) == [[0, 1], [2]]
    triangle = edges(spark, [(0, 1, 0.9), (1, 2, 0.8), (0, 2, 0.7)])
    assert clusters(graphs.complete_linkage_clusters(nodes(spark, 3), triangle, 0.5)) == [[0, 1, 2]]


@pytest.mark.parametrize("seed", [1, 2])
def test_linkage_and_caps_in_rounds(spark, monkeypatch, seed):
    """With many ties, and components of more edges than a group may hold."""
    monkeypatch.setattr(graphs, "MAX_GROUP_EDGES", 3)
    draw = random.Random(seed)
    n, cap = 24, 4
    sims = {(i, j): draw.randint(3, 8) / 10 for i in range(n) for j in range(i + 1, n) if draw.random() < 0.4}
    table = spark.createDataFrame([(i, j, s) for (i, j), s in sims.items()], "i long, j long, sim double")

    held = {k: {k} for k in range(n)}
    while True:
        least = {(a, b): min(sims.get((min(x, y), max(x, y)), 0) for x in held[a] for y in held[b]) for a in held for b in held if a < b}
        s, a, b = max(((s, -a, -b) for (a, b), s in least.items()), default=(0, 0, 0))
        if s < 0.4:
            break
        held[-a] |= held.pop(-b)
    assert clusters(graphs.complete_linkage_clusters(nodes(spark, n), table, 0.4)) == sorted(map(sorted, held.values()))

    def parts(ids, pairs):
        of = {k: {k} for k in ids}
        for _, a, b in pairs:
            if of[a] is not of[b]:
                of[a] |= of[b]
                of.update(dict.fromkeys(of[a], of[a]))
        return [sorted(x) for x in {id(x): x for x in of.values()}.values()]

    first = sorted((s, i, j) for (i, j), s in sims.items() if s >= 0.4)
    todo, done = [(x, [p for p in first if p[1] in x]) for x in parts(range(n), first)], []
    while todo:
        ids, pairs = todo.pop()
        if len(ids) <= cap:
            done.append(ids)
        else:
            todo += [(x, [p for p in pairs[1:] if p[1] in x]) for x in parts(ids, pairs[1:])]
    assert clusters(graphs.capped_clusters(nodes(spark, n), table, 0.4, cap)) == sorted(done)


def test_capped_and_coloured(spark):
    e = edges(spark, [(k, k + 1, 0.6 + k / 100) for k in range(9)])
    found = clusters(graphs.capped_clusters(nodes(spark, 10), e, 0.5, 4))
    assert all(len(c) <= 4 for c in found) and sum(map(len, found)) == 10
    rows = [(k, 0, "c0" if k < 3 else "c1", 0.0, 5.0, float(k)) for k in range(4)]
    parts = graphs.coloured_clusters(spark.createDataFrame(rows, "node long, cluster long, camera_id string, start double, end double, strength double")).collect()
    assert {r.node: r.part for r in parts} == {3: 0, 2: 0, 1: 1, 0: 2}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def boxes(spark, rows):
    return spark.createDataFrame([(k, "c0", t, f, *b, c, 0) for k, (t, f, b, c) in enumerate(rows)], "event_id long, camera_id string, track_id long, frame_id long, x double, y double, w double, h double, confidence double, class_id int")


def test_suppression(spark):
    rng = random.Random(2)
    rows = [(k, k % 3, (rng.uniform(0, 50), rng.uniform(0, 50), 20.0, 20.0), round(rng.random(), 3)) for k in range(60)]
    kept = T.suppressed(boxes(spark, rows), 0.3).collect()

    def iou(a, b):
        w, h = max(0, min(a[0], b[0]) + 20 - max(a[0], b[0])), max(0, min(a[1], b[1]) + 20 - max(a[1], b[1]))
        return w * h / (800 - w * h)

    want = set()
    for f in range(3):
        own = []
        for t, _, b, c in sorted((r for r in rows if r[1] == f), key=lambda r: -r[3]):
            if all(iou(b, o) <= 0.3 for o in own):
                own.append(b)
                want.add(t)
    assert {r.track_id for r in kept} == want


def test_gaps_and_trim(spark):
    rows = boxes(spark, [(1, 0, (0.0, 0.0, 10.0, 10.0), 0.5), (1, 4, (40.0, 0.0, 10.0, 10.0), 0.5), (1, 20, (0.0, 0.0, 1.0, 1.0), 0.5)])
    made = T.filled_gaps(rows, 5).where("confidence = 0").orderBy("frame_id").collect()
    assert [(r.frame_id, r.x) for r in made] == [(1, 10.0), (2, 20.0), (3, 30.0)]
    rows = boxes(spark, [(1, k, (0.0, 0.0, 1.0, 1.0), c) for k, c in enumerate([0.1, 0.9, 0.2, 0.9, 0.9, 0.1])])
    assert sorted(r.frame_id for r in T.trimmed_by_confidence(rows).collect()) == [1, 2, 3, 4]


def test_moving_tracks(spark):
    rows = boxes(spark, [(1, k, (10.0 * k, 0.0, 5.0, 5.0), 1.0) for k in range(4)] + [(2, k, (float(k % 2), 0.0, 5.0, 5.0), 1.0) for k in range(4)] + [(3, 0, (0.0, 0.0, 5.0, 5.0), 1.0)])
    assert [r.track_id for r in T.moving_tracks(rows, 20.0).collect()] == [1]


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (5, 3), (4, 4)])
def test_assignment(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(20):
        cost = rng.random(shape)
        got = sum(cost[a, b] for a, b in evaluation.best_assignment(cost))
        n, m = shape
        if n <= m:
            best = min(sum(cost[k, p[k]] for k in range(n)) for p in itertools.permutations(range(m), n))
        else:
            best = min(sum(cost[p[k], k] for k in range(m)) for p in itertools.permutations(range(n), m))
        assert got == pytest.approx(best)
    assert evaluation.best_assignment(np.empty((0, 3))) == []


def test_identity_and_ground_scores(spark):
    truth = boxes(spark, [(t, f, (50.0 * t, 0.0, 10.0, 10.0), 1.0) for t in range(2) for f in range(10)])
    swapped = boxes(spark, [(t if f < 6 else 1 - t, f, (50.0 * t, 0.0, 10.0, 10.0), 1.0) for t in range(2) for f in range(10)])
    (row,) = evaluation.identity_scores(swapped, truth, 0.5).collect()
    assert (row.idtp, row.idfp, row.idfn) == (12, 8, 8) and row.idf1 == pytest.approx(0.6)
    (row,) = evaluation.ground_scores(swapped, truth, 5.0).collect()
    assert (row.tp, row.fp, row.fn, row.moda) == (20, 0, 0, 1.0)


def features(spark, n=60, d=8, cameras=3):
    rng = np.random.default_rng(0)
    m = rng.standard_normal((n, d))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    rows = [(k, f"S01_c00{k % cameras}", k % 2, m[k].tolist()) for k in range(n)]
    return m, spark.createDataFrame(rows, "index_id long, camera_id string, class_id int, v array<double>")


def test_blocks_don_t_change_pairs(spark, monkeypatch):
    m, rows = features(spark)
    want = {(i, j) for i in range(60) for j in range(60) if i % 3 < j % 3 and i % 2 == j % 2 and m[i] @ m[j] >= 0.3}
    for small, block in ((simjoin.SMALL, 512), (0, 512), (0, 7)):  # the broadcast way, one block, many blocks
        monkeypatch.setattr(simjoin, "SMALL", small)
        monkeypatch.setattr(simjoin.block_pairs, "__defaults__", (block,))
        assert {(r.i, r.j) for r in simjoin.similar_pairs(rows, 0.3).collect()} == want
        near = {(r.i, r.j) for r in simjoin.nearest(rows, 2).collect()}
        for i in range(60):
            others = sorted((j for j in range(60) if j % 3 != i % 3 and j % 2 == i % 2), key=lambda j: (-m[i] @ m[j], j))[:2]
            assert {(i, j) for j in others} <= near
        assert len(near) == 120


@pytest.mark.parametrize("small", [simjoin.SMALL, 0])
def test_rows_without_scene_meet_all(spark, monkeypatch, small):
    monkeypatch.setattr(simjoin, "SMALL", small)
    v = [1.0, 0.0]
    rows = spark.createDataFrame([(0, "S01_a", 0, v), (1, "S02_b", 0, v), (2, "q", 0, v), (3, "r", 0, v)], "index_id long, camera_id string, class_id int, v array<double>")
    assert sorted((r.i, r.j) for r in simjoin.similar_pairs(rows, 0.5).collect()) == [(0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]


def test_whitening(spark):
    m, rows = features(spark, 200)
    out = np.array([r.v for r in P.pca_whitened(rows, 4).orderBy("index_id").collect()])
    assert np.allclose(np.cov(out.T), np.eye(4), atol=1e-6)
    few = rows.where("camera_id <> 'S01_c002' OR index_id < 9")
    got = {r.index_id: r.v for r in P.camera_whitened(few, min_rows=5).collect()}
    assert np.allclose(got[2], m[2]) and all(abs(np.linalg.norm(v) - 1) < 1e-6 for v in got.values())


def test_pools(spark):
    m, rows = features(spark)
    (row,) = P.geometric_median(rows.where("index_id < 9").withColumn("g", F.lit(1)), ["g"], rounds=12).collect()

    centre = m[:9].mean(0)
    for _ in range(12):
        w = 1 / np.linalg.norm(m[:9] - centre, axis=1)
        centre = w @ m[:9] / w.sum()
    assert np.allclose(row.v, centre / np.linalg.norm(centre), atol=1e-9)
    assert P.medoid(rows.withColumn("g", F.lit(1)), ["g"]).first().index_id == int((m @ m.sum(0)).argmax())


def test_search_in_several_passes(spark, monkeypatch):
    m, rows = features(spark)
    monkeypatch.setattr(search._probe_blocks, "__defaults__", (4,))
    got = {(r.probe_id, r.index_id) for r in search.top_matches(rows.where("index_id < 10"), rows, 3, exclude_self=True).collect()}
    want = {(i, j) for i in range(10) for j in sorted((j for j in range(60) if j != i), key=lambda j: (-m[i] @ m[j], j))[:3]}
    assert got == want


def test_search_orders_copies_by_id(spark):
    rows = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(40, 0, -1)], "index_id long, v array<double>").coalesce(1)
    got = search.top_matches(rows.where("index_id = 40"), rows, 3).collect()
    assert sorted((r.place, r.index_id) for r in got) == [(1, 1), (2, 2), (3, 3)]


def test_all_matches(spark, monkeypatch):
    m, rows = features(spark)
    monkeypatch.setattr(search, "MAX_PAIRS", 50)
    monkeypatch.setattr(search._probe_blocks, "__defaults__", (4,))
    got = {(r.probe_id, r.index_id): r.sim for r in search.all_matches(rows.where("index_id < 10"), rows, exclude_self=True).collect()}
    assert got == pytest.approx({(i, j): m[i] @ m[j] for i in range(10) for j in range(60) if i != j})


def test_scores(spark):
    row = spark.range(1).select(
        scoring.temporal_overlap(F.lit(0.0), F.lit(10.0), F.lit(5.0), F.lit(7.0)).alias("inside"),
        scoring.temporal_overlap(F.lit(0.0), F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("apart"),
        scoring.global_score(F.lit(100.0), 0.0, 100.0).alias("far"), scoring.global_score(F.lit(0.0), 0.0, 100.0).alias("near"),
        scoring.alert_level(F.lit(0.9), F.lit(0.7)).alias("level"),
        names.track_number(F.lit("det-17")).alias("n"), names.plain_camera(F.lit("query_S01_c003")).alias("camera"), names.camera_of_path(F.lit("/a/c004/vdo.avi")).alias("path"),
        geometry.in_convex_polygon(F.lit(1.0), F.lit(1.0), [(0, 0), (2, 0), (2, 2), (0, 2)]).alias("in_"),
        F.round(V.norm(V.normalized(F.array(F.lit(3.0), F.lit(4.0)))), 9).alias("unit"),
    ).first()
    assert (row.inside, row.apart, row.near, row.level, row.n, row.camera, row.path, row.in_, row.unit) == (1.0, 0.0, 1.0, "HIGH", 17, "c003", "c004", True, 1.0)
    assert row.far == pytest.approx(0.01)


def test_skyline(spark):
    rng = random.Random(5)
    points = [(k, rng.randrange(30), rng.randrange(30)) for k in range(200)] + [(900, None, 5)]
    got = {r.k for r in evaluation.skyline(spark.createDataFrame(points, "k long, a long, b long"), "a", "b").collect()}
    real = [p for p in points if p[1] is not None]
    assert got == {k for k, a, b in real if not any(x >= a and y >= b and (x > a or y > b) for _, x, y in real)}


def test_readers_skip_broken_rows(spark):
    path = scratch_dir(spark)
    spark.createDataFrame([("1,2,3,4,5,6,0.5,1,1",), ("broken",), ("1,2,3",), ("2,2,3,4,5,6,0",), ("3,2,3,4,5,6,x",)], "value string").coalesce(1).write.text(path)
    assert sources.read_mot(spark, path).count() == 2
    assert sorted(r.confidence for r in sources.read_scored_mot(spark, path).collect()) == [0.5, 1.0]
    path = scratch_dir(spark)
    spark.createDataFrame([("c1 7 3 1 2 3 4 -1 -1",), ("c1 7 3",)], "value string").write.text(path)
    assert [(r.camera_id, r.track_id, r.frame_id) for r in sources.read_aic(spark, path).collect()] == [("c1", 7, 3)]


def test_ground_truth_files(spark, tmp_path):
    def person(pid, pos, *views):
        return {"personID": pid, "positionID": pos, "views": [{"viewNum": k, "xmin": a, "ymin": 0, "xmax": b, "ymax": 9} for k, a, b in views]}

    (tmp_path / "00000005.json").write_text(json.dumps([person(1, 481, (0, 3, 8), (1, -1, -1)), person(1, 7, (0, 1, 2)), person(2, 3, (0, -1, -1))]))
    rows = sources.read_ground_truth(spark, str(tmp_path)).collect()
    assert [(r.frame_id, r.person_id, r.x_cm, r.y_cm) for r in rows] == [(5, 1, -297.5, -897.5)]
    views = sources.read_ground_views(spark, str(tmp_path)).collect()
    assert sorted((r.track_id, r.camera_id, r.xmin) for r in views) == [(1, "C1", 1.0), (1, "C1", 3.0)]


def test_trajectory_defaults(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"globalId": 4, "tracklets": [{"camera_id": "a", "track_id": 1}, {"camera_id": "b", "track_id": 2}]}\n{"global_id": 5, "confidence": 0.5, "num_cameras": 9}\n')
    got = {r.global_id: (r.confidence, r.num_cameras) for r in sources.read_trajectories(spark, str(tmp_path)).collect()}
    assert got[4] == (0.0, 2) and got[5] == (0.5, 9)


def test_upsert_and_report(spark):
    a = spark.createDataFrame([(1, 1, "old"), (2, 1, "kept")], "id long, version long, x string")
    b = spark.createDataFrame([(1, 2, "new"), (3, 1, "more")], "id long, version long, x string")
    assert {(r.id, r.x) for r in sinks.upserted(a, b, "id", "version").collect()} == {(1, "new"), (2, "kept"), (3, "more")}


@pytest.mark.parametrize("kind", ["kalman", "nearest"])
def test_tracker_follows_two_people(kind):
    tracks = trackers.KalmanTracks(trackers.KalmanParameters()) if kind == "kalman" else trackers.NearestTracks(trackers.NearestParameters())
    seen = {}
    for f in [f for f in range(12) if f != 5]:
        points = np.array([[10.0 * f, 0.0], [500.0 - 10.0 * f, 300.0]])
        for point, (track, hits) in zip(points, tracks.update(f, points), strict=True):
            seen.setdefault(track, []).append((point[1], hits))
    assert len(seen) == 2 and all(len({y for y, _ in rows}) == 1 and rows[-1][1] == 11 for rows in seen.values())


@pytest.mark.parametrize("silence", [2, 3, 4])
def test_kalman_tracks_survive_two_silent_frames(silence):
    tracks = trackers.KalmanTracks(trackers.KalmanParameters())
    first = [tracks.update(f, np.array([[0.0, 0.0]]))[0][0] for f in range(4)]
    (again, _), = tracks.update(4 + silence, np.array([[0.0, 0.0]]))
    assert set(first) == {0} and again == (0 if silence <= 2 else 1)


@pytest.mark.parametrize("run, step", [(trackers.ground_tracks, 4), (trackers.nearest_tracks, 6)])
def test_tracks_of_scenes_are_apart(spark, run, step):
    rows = [(s, f, 10.0 * f + 1000 * k, 0.0) for k, s in enumerate("ab") for f in range(6)] + [("a", 5 + step + f, 50.0, 0.0) for f in range(3)] + [("b", 90, 0.0, 0.0)]
    got = {}
    for r in run(spark.createDataFrame(rows, "scene string, frame_id long, x double, y double")).collect():
        got.setdefault((r.scene, r.track_id), set()).add(r.frame_id)
    assert sorted((s, sorted(f)) for (s, _), f in got.items()) == [("a", list(range(6))), ("a", [5 + step, 6 + step, 7 + step]), ("b", list(range(6)))]


def test_stream_equals_batch(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    table = spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    folder = scratch_dir(spark)
    table.repartition(1).write.parquet(folder)
    batch = {(r.user_id, r.start, r.n) for r in sessions.session_tracklets(table, "12 hours").collect()}
    stream = sessions.session_tracklets(spark.readStream.schema(table.schema).parquet(folder), "12 hours", "1 minute")
    run = stream.writeStream.outputMode("append").format("memory").queryName("closed_sessions").option("checkpointLocation", scratch_dir(spark)).start()
    run.processAllAvailable()
    run.stop()
    closed = {(r.user_id, r.start, r.n) for r in spark.sql("SELECT * FROM closed_sessions").collect()}
    assert closed and closed <= batch and len(batch) - len(closed) <= len({u for u, _, _ in batch})


def test_corrections(spark):
    log = [(1, "merge", 7, 8), (2, "merge", 7, 9), (3, "undo", None, None), (4, "merge", 5, 6), (5, "undo", None, None), (6, "merge", 5, 4)]
    log = [("a", *r) for r in log] + [("b", 1, "undo", None, None), ("b", 7, "merge", 1, 2), ("b", 8, "undo", None, None), ("b", 9, "undo", None, None)]
    frame = spark.createDataFrame(log, "log_id string, id long, action string, source_gid long, target_gid long")
    live = sessions.active_corrections(frame)
    assert sorted(r.id for r in live.collect()) == [1, 6]
    table = spark.createDataFrame([("a", 7), ("b", 5), ("c", 1)], "tracklet string, global_id long")
    assert {r.tracklet: r.global_id for r in sessions.relabelled(table, live).collect()} == {"a": 8, "b": 4, "c": 1}


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_partitions_don_t_change_results(spark, partitions):
    import __spark_entry__ as entry

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = sorted(map(tuple, entry.queries()["win01_mutual_topk"](spark, "/root/testdata/sf0.001").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len({r[:2] for r in got}) > 500


def test_reranking(spark):
    m, rows = features(spark, 50, 6, 2)
    k1, k2, weight = 8, 3, 0.3
    d = 2 - 2 * m @ m.T
    np.fill_diagonal(d, 0)
    order = np.argsort(d + 1e-12 * np.arange(50)[None, :] - 10 * np.eye(50), axis=1, kind="stable")
    near = lambda i, k: set(order[i, : k + 1])
    mutual = lambda i, k: {j for j in near(i, k) if i in near(j, k)}
    v = np.zeros((50, 50))
    for i in range(50):
        wide = mutual(i, k1)
        whole = set(wide)
        for c in wide:
            tight = mutual(c, round(k1 / 2))
            if len(tight & wide) > 2 / 3 * len(tight):
                whole |= tight
        whole = sorted(whole)
        v[i, whole] = np.exp(-d[i, whole]) / np.exp(-d[i, whole]).sum()
    v = np.stack([v[order[i, :k2]].mean(0) for i in range(50)])
    pairs = [(i, j) for i in range(5) for j in range(50) if i != j]
    got = {(r.i, r.j): r.distance for r in simjoin.reranked(rows, spark.createDataFrame(pairs, "i long, j long"), k1, k2, weight).collect()}
    for i, j in pairs:
        least = np.minimum(v[i], v[j]).sum()
        assert got[i, j] == pytest.approx(weight * d[i, j] + (1 - weight) * (1 - least / (2 - least)))


def test_reranking_of_all_rows(spark):
    _, rows = features(spark, 50, 6, 2)
    pairs = spark.createDataFrame([(i, j) for i in range(5) for j in range(50) if i != j], "i long, j long")
    want = {(r.i, r.j): r.distance for r in simjoin.reranked(rows, pairs, 8, 3, 0.3).collect()}
    got = {(r.i, r.j): r.distance for r in simjoin.reranked_all(rows, rows.where("index_id < 5"), 8, 3, 0.3).collect()}
    assert got == pytest.approx(want)


def test_reranked_query_scores_every_row(spark):
    sf = "/root/testdata/sf0.001"
    rows = vector_queries.features(spark, sf)
    got = [(r.i, r.j) for r in retrieval_queries.vec19(spark, sf).collect()]
    ids = [r.index_id for r in rows.select("index_id").collect()]
    assert sorted(got) == sorted((i, j) for i in ids if i % 50 == 0 for j in ids if i != j)


def test_temporal_split(spark):
    rows = [(0, 1, 0.0, 5.0, [1.0, 0.0]), (1, 1, 3.0, 8.0, [1.0, 0.0]), (2, 1, 50.0, 55.0, [0.0, 1.0]), (3, 1, 200.0, 210.0, [-1.0, 0.0]), (4, 2, 0.0, 1.0, [1.0, 0.0]), (5, 2, 90.0, 91.0, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "index_id long, cluster long, start double, end double, v array<double>")
    parts = {}
    for r in trajectories.temporal_split(frame, 20.0, 0.5).collect():
        parts.setdefault(r.cluster, set()).add(r.index_id)
    assert sorted(map(sorted, parts.values())) == [[0, 1], [2], [3], [4, 5]]


def test_smoothing(spark):
    rows = boxes(spark, [(1, k, (10.0 * k + (3 if k % 2 else -3), 5.0, 10.0, 10.0), 1.0) for k in range(12)] + [(2, k, (7.0, 5.0, 10.0, 10.0), 1.0) for k in range(3)])
    got = {(r.track_id, r.frame_id): r.x for r in trajectories.smoothed(rows, 5, 2).collect()}
    x = np.array([10.0 * k + (3 if k % 2 else -3) + 5 for k in range(12)])
    w = trajectories.smoothing_weights(5, 2)
    for k in range(12):
        start = max(0, min(k - 2, 7))
        assert got[1, k] == pytest.approx(round(float(w[k - start] @ x[start : start + 5]) - 5, 1), abs=0.11)
    assert len(got) == 15 and got[2, 1] == 7.0


def test_merged_points(spark):
    rows = [(0, 1, 0.0, 0.0), (0, 1, 8.0, 0.0), (0, 2, 15.0, 0.0), (0, 3, 100.0, 0.0), (1, 4, 1.0, 1.0)]
    got = sorted((r.frame_id, r.track_id, round(r.x, 3)) for r in trajectories.merged_ground_points(spark.createDataFrame(rows, "frame_id long, track_id long, x double, y double"), 10.0).collect())
    assert got == [(0, 1, 7.667), (0, 3, 100.0), (1, 4, 1.0)]


def test_clear_scores(spark):
    truth = boxes(spark, [(t, f, (50.0 * t, 0.0, 10.0, 10.0), 1.0) for t in range(2) for f in range(10)])
    swapped = boxes(spark, [(t if f < 6 else 1 - t, f, (50.0 * t, 0.0, 10.0, 10.0), 1.0) for t in range(2) for f in range(10)])
    (row,) = trajectories.clear_scores(evaluation.box_matches(swapped, truth, 0.5), swapped, truth).collect()
    assert (row.misses, row.false_positives, row.switches) == (0, 0, 2) and row.mota == pytest.approx(0.9)


def test_pair_auc(spark):
    rng = random.Random(8)
    pairs = [(round(rng.random(), 2), rng.random() < 0.3) for _ in range(400)]
    (row,) = evaluation.pair_auc(spark.createDataFrame(pairs, "score double, same boolean")).collect()
    p, n = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    assert row.auc == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n)))


def test_linked_trajectories(spark):
    links = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (3, 4, 0.7)], "source long, target long, score double")
    cameras = spark.createDataFrame([(1, ["a"]), (2, ["b"]), (3, ["a"]), (4, ["c"]), (5, ["d"])], "node long, cameras array<string>")
    assert clusters(graphs.linked_trajectories(links, cameras)) == [[1, 2], [3, 4], [5]]


def test_hota(spark):
    truth = boxes(spark, [(t, f, (50.0 * t, 0.0, 10.0, 10.0), 1.0) for t in range(2) for f in range(10)])
    (row,) = trajectories.hota_scores(evaluation.box_matches(truth, truth, 1e-6), truth, truth).collect()
    assert (row.hota, row.det_a, row.ass_a) == pytest.approx((1.0, 1.0, 1.0))
    halves = boxes(spark, [(t + 2 * (f >= 5), f, (50.0 * t, 0.0, 10.0, 10.0), 1.0) for t in range(2) for f in range(10)])
    (row,) = trajectories.hota_scores(evaluation.box_matches(halves, truth, 1e-6), halves, truth).collect()
    assert (row.det_a, row.ass_a) == pytest.approx((1.0, 0.5)) and row.hota == pytest.approx(0.5**0.5)


def test_multi_query_pairs(spark):
    rows = [(0, "S01_a", 0, [1.0, 0.0], [[1.0, 0.0], [0.0, 1.0]]), (1, "S01_b", 0, [0.0, 1.0], None), (2, "S01_c", 0, [-1.0, 0.0], [])]
    frame = spark.createDataFrame(rows, "index_id long, camera_id string, class_id int, v array<double>, queries array<array<double>>")
    got = {(r.i, r.j): r.sim for r in simjoin.multi_query_pairs(frame, -2.0, 0.5).collect()}
    assert got == pytest.approx({(0, 1): 0.5, (0, 2): -0.5, (1, 2): 0.0})


def test_clear_scores_stream_frames(spark, monkeypatch):
    """No group holds a component: frames are streamed, also where they reach over Arrow batches."""
    monkeypatch.setattr("pyspark.sql.GroupedData.applyInPandas", None)
    rows = [("c0", f, p, g, iou) for f in range(6) for p, g, iou in ((1, 11, 0.9 if f < 3 else 0.2), (1, 12, 0.5), (2, 12, 0.6), (2, 11, 0.4), (1, 11, 0.3))]
    rows = [r for r in rows if not (r[1] == 3 and r[2] == 1 and r[3] == 11)]  # the pair (1, 11) is lost in frame 3
    boxes = {k: spark.createDataFrame([("c0", f, t) for f in range(6) for t in ids], "camera_id string, frame_id long, track_id long") for k, ids in (("p", (1, 2)), ("g", (11, 12)))}
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(size)
    try:
        spark.conf.set(size, "2")
        found = trajectories.clear_scores(spark.createDataFrame(rows, "camera_id string, frame_id long, pred_id long, gt_id long, iou double"), boxes["p"], boxes["g"]).first()
    finally:
        spark.conf.set(size, old)
    # In frame 3 the pair (2, 12) stays and 11 has no partner left but 2; afterwards (1, 11) is made again.
    assert (found.n_gt, found.misses, found.false_positives, found.switches) == (12, 1, 1, 0)
