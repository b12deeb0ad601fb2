"""Queries without SQL against plain Python over the same tables, and reference cases of their operators."""

import math
import random
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.test_operators import clusters, edges
from trackloom.operators import expansion, reports, retrieval
from trackloom.operators import vectors as P
from trackloom.plans import views
from trackloom.plans.vector_queries import _boxes, _members, _nodes

SF = "/root/testdata/sf0.01"


def run(spark, name):
    return entry.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def scored(spark):
    return sorted(((r.sim, r.i, r.j) for r in views.edges(spark, SF).collect()), key=lambda e: (-e[0], e[1], e[2]))


@pytest.fixture(scope="module")
def vectors(spark):
    return {r.index_id: r for r in views.features(spark, SF).collect()}


def parts_of(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in root}


def grouped(rows):
    out = defaultdict(set)
    for n, c in rows:
        out[c].add(n)
    return sorted(map(sorted, out.values()))


def test_complete_linkage(spark, scored, vectors):
    held = {n: {n} for n in vectors}
    sims = {frozenset((i, j)): s for s, i, j in scored}
    least = {frozenset((i, j)): s for s, i, j in scored}
    while least:
        s = max(least.values())
        if s < 0.25:
            break
        a, b = min((tuple(sorted(k)) for k, v in least.items() if v == s))
        held[a] |= held.pop(b)
        least = {k: v for k, v in least.items() if b not in k}
        for c in held:
            if c != a:
                worst = min(sims.get(frozenset((x, y)), 0.0) for x in held[a] for y in held[c])
                least.pop(frozenset((a, c)), None)
                if worst > 0:
                    least[frozenset((a, c))] = worst
    assert grouped((r.node, r.cluster) for r in run(spark, "gra07_complete_linkage")) == sorted(map(sorted, held.values()))


def test_capped(spark, scored, vectors):
    todo, done = [(set(vectors), sorted((s, i, j) for s, i, j in scored))], []
    while todo:
        nodes, pairs = todo.pop()
        of = parts_of(nodes, [(i, j) for _, i, j in pairs])
        for root in set(of.values()):
            part = {n for n in nodes if of[n] == root}
            own = [e for e in pairs if e[1] in part]
            if len(part) <= 8:
                done.append(sorted(part))
            else:
                todo.append((part, own[1:]))
    assert grouped((r.node, r.cluster) for r in run(spark, "gra08_capped")) == sorted(done)


def most(table):
    """The largest total of a one-to-one choice, by successive longest paths."""
    rows, cols = sorted({a for a, _ in table}), sorted({b for _, b in table})
    taken_by, total = {}, 0.0
    for _ in range(min(len(rows), len(cols))):
        gain, how = {("r", r): 0.0 for r in rows if r not in taken_by.values()}, {}
        changed = True
        while changed:
            changed = False
            for (r, c), w in table.items():
                if ("r", r) in gain and taken_by.get(c) != r and gain["r", r] + w > gain.get(("c", c), -math.inf) + 1e-12:
                    gain["c", c], how["c", c], changed = gain["r", r] + w, ("r", r), True
            for c, r in taken_by.items():
                if ("c", c) in gain and gain["c", c] - table[r, c] > gain.get(("r", r), -math.inf) + 1e-12:
                    gain["r", r], how["r", r], changed = gain["c", c] - table[r, c], ("c", c), True
        free = [(g, c) for (k, c), g in gain.items() if k == "c" and c not in taken_by]
        if not free or max(free)[0] <= 0:
            break
        best, c = max(free)
        total += best
        at = ("c", c)
        while True:
            r = how[at][1]
            before = how.get(("r", r))
            taken_by[at[1]] = r
            if before is None:
                break
            at = before
    return total


def test_most_is_right():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randrange(1, 5)
        table = {(a, b): rng.randrange(1, 9) for a in range(n) for b in range(n) if rng.random() < 0.7}
        want = max(sum(table.get((a, p[a]), 0) for a in range(n)) for p in permutations(range(n)))
        assert most(table) == pytest.approx(want)


def test_identity_scores(spark):
    mine, truth = (f.collect() for f in _boxes(spark, SF))
    by_frame = defaultdict(list)
    for g in truth:
        by_frame[g.camera_id, g.frame_id].append(g)
    one, all_ = defaultdict(lambda: defaultdict(set)), defaultdict(set)
    for p in mine:
        for g in by_frame[p.camera_id, p.frame_id]:
            wide = max(0, min(p.x + p.w, g.x + g.w) - max(p.x, g.x)) * max(0, min(p.y + p.h, g.y + g.h) - max(p.y, g.y))
            if wide / (p.w * p.h + g.w * g.h - wide) >= 0.3:
                one[p.camera_id][p.track_id, g.track_id].add(p.frame_id)
                all_[p.track_id, g.track_id].add((p.camera_id, p.frame_id))
    got = {r.camera_id: r.idtp for r in run(spark, "evl02_identity_scores")}
    assert got == {c: round(most({k: len(v) for k, v in one[c].items()})) for c in got} and max(got.values()) > 100
    (row,) = run(spark, "evl03_global_identity_scores")
    assert row.idtp == round(most({k: len(v) for k, v in all_.items()})) and row.idtp + row.idfp == len(mine) and row.idtp + row.idfn == len(truth)


def test_ground_scores(spark):
    mine, truth = (f.collect() for f in _boxes(spark, SF))
    by_frame = defaultdict(lambda: (defaultdict(list), defaultdict(list)))
    for k, rows in enumerate((mine, truth)):
        for r in rows:
            by_frame[r.frame_id][k][r.track_id].append((r.x, r.y))
    tp = 0
    for a, b in by_frame.values():
        near = {p: [g for g in b if any(math.hypot(x - u, y - v) <= 50 for x, y in a[p] for u, v in b[g])] for p in a}
        match = {}

        def free(p, seen, near=near, match=match):
            for g in near[p]:
                if g not in seen:
                    seen.add(g)
                    if g not in match or free(match[g], seen):
                        match[g] = p
                        return True
            return False

        tp += sum(free(p, set()) for p in near)
    (row,) = run(spark, "evl05_ground_scores")
    assert (row.tp, row.fp, row.fn) == (tp, len(mine) - tp, len(truth) - tp)


def test_fragments(spark):
    rows = defaultdict(list)
    for r in views.chopped(spark, SF).collect():
        rows[r.camera_id, r.track_id].append(r)
    facts = []
    for (camera, track), own in rows.items():
        own.sort(key=lambda r: (r.frame_id, r.event_id))
        counts = defaultdict(int)
        for r in own:
            counts[r.class_id] += 1
        facts.append((camera, max(counts, key=lambda c: (counts[c], -c)), own[0].frame_id, own[-1].frame_id, track, own[0], own[-1]))
    facts.sort(key=lambda f: f[:5])

    def iou(a, b):
        wide = max(0, min(a.x + a.w, b.x + b.w) - max(a.x, b.x)) * max(0, min(a.y + a.h, b.y + b.h) - max(a.y, b.y))
        return wide / (a.w * a.h + b.w * b.h - wide)

    want, taken = {}, set()
    by = defaultdict(list)
    for f in facts:
        by[f[:2]].append(f)
    for own in by.values():
        for k, (camera, _, _, end, track, _, tail) in enumerate(own):
            if (camera, track) in taken:
                continue
            want[camera, track] = track
            for _, _, start, stop, other, head, last in own[k + 1 :]:
                if (camera, other) not in taken and 0 <= start - end <= 24 and iou(tail, head) >= 1 - 0.7:
                    want[camera, other] = track
                    taken.add((camera, other))
                    if stop >= end:
                        end, tail = stop, last
    got = {(r.camera_id, r.track_id): r.merged_id for r in run(spark, "gra15_merged_fragments")}
    assert got == want and any(t != m for (_, t), m in want.items())


def test_verified_merges(spark, scored):
    facts = {r.node: r for r in _nodes(spark, SF).collect()}
    by_pair = defaultdict(dict)
    for s, i, j in scored:
        a, b = sorted((i, j), key=lambda n: facts[n].camera_id)
        by_pair[facts[a].camera_id, facts[b].camera_id][a, b] = s
    got = grouped((r.node, r.cluster) for r in run(spark, "gra05_verified_merges"))
    sims = {frozenset((i, j)): s for s, i, j in scored}
    for part in got:  # each cluster is free of conflicts, and each pair of its cameras has a direct edge
        for a in part:
            for b in part:
                same = facts[a].camera_id == facts[b].camera_id
                assert a == b or not same or facts[a].start > facts[b].end or facts[b].start > facts[a].end
        cameras = {facts[n].camera_id for n in part}
        for c in cameras:
            for d in cameras - {c}:
                assert any(frozenset((a, b)) in sims for a in part for b in part if (facts[a].camera_id, facts[b].camera_id) == (c, d))
    total = sum(most({k: s - 0.25 + 1e-6 for k, s in pair.items()}) for pair in by_pair.values())
    assert total > 0 and any(len(p) > 2 for p in got)


@pytest.mark.parametrize("third, want", [(0.41, [[0, 1], [2]]), (0.88, [[0, 1, 2]])])
def test_merges_need_every_pair_of_cameras(spark, third, want):
    nodes = spark.createDataFrame([(0, "cam_a", 0.0, 1.0), (1, "cam_b", 5.0, 6.0), (2, "cam_c", 10.0, 11.0)], "node long, camera_id string, start double, end double")
    assert clusters(expansion.verified_merges(nodes, edges(spark, [(0, 1, 0.92), (1, 2, 0.90), (0, 2, third)]), 0.5)) == want


def test_merges_take_the_best_assignment(spark):
    nodes = spark.createDataFrame([(k, "ab"[k > 1], 10.0 * k, 10.0 * k + 1) for k in range(4)], "node long, camera_id string, start double, end double")
    assert clusters(expansion.verified_merges(nodes, edges(spark, [(0, 2, 0.9), (0, 3, 0.85), (1, 2, 0.8)]), 0.5)) == [[0, 3], [1, 2]]


def member_rows(spark, rows):
    """(node, cluster, camera, class, start, end, angle): unit vectors in the plane."""
    data = [(n, c, cam, k, float(s), float(e), [math.cos(a), math.sin(a)], [1.0, 0.0]) for n, c, cam, k, s, e, a in rows]
    return spark.createDataFrame(data, "node long, cluster long, camera_id string, class_id int, start double, end double, v array<double>, color array<double>")


def test_gallery_expansion(spark):
    rows = [(0, 0, "S01_a", 0, 0, 1, 0.0), (1, 0, "S01_b", 0, 10, 11, 0.3), (2, 2, "S01_c", 0, 20, 21, 0.5), (3, 3, "S01_d", 0, 30, 31, 0.7), (4, 4, "S01_c", 0, 20.5, 22, 0.31), (5, 5, "S01_e", 1, 40, 41, 0.1), (6, 6, "S02_a", 0, 40, 41, 0.1), (7, 7, "S01_f", 0, 40, 41, 2.0), (8, 8, "S01_g", 0, 50, 51, 2.3), (9, 9, "S01_h", 0, 5000, 5001, 0.2)]
    members, none = member_rows(spark, rows), edges(spark, []) if False else spark.createDataFrame([], "i long, j long, sim double")
    got = clusters(expansion.gallery_expanded(members, none, math.cos(0.21), 2, 0.9))
    # 2 comes first and then brings 3 near; 4 overlaps with 2 in a camera; 5 is of another class, 6 of another
    # scene, 9 too late; 7 and 8 are tied to each other.
    assert got == [[0, 1, 2, 3], [4], [5], [6], [7, 8], [9]]
    higher = spark.createDataFrame([(4, 8, 0.99)], "i long, j long, sim double")
    assert [4, 7, 8] in clusters(expansion.gallery_expanded(members, higher, math.cos(0.21), 2, 0.9))


def test_hierarchical_expansion(spark):
    rows = [(0, 0, "S01_a", 0, 0, 1, 0.0), (1, 0, "S01_b", 0, 10, 11, 0.2), (2, 2, "S01_c", 0, 20, 21, 0.25), (3, 3, "S01_d", 0, 30, 31, 0.3), (4, 3, "S01_e", 0, 40, 41, 0.5), (5, 5, "S01_a", 0, 50, 51, 1.5), (6, 6, "S01_b", 0, 60, 61, 1.6), (7, 7, "S01_c", 1, 70, 71, 0.1)]
    none = spark.createDataFrame([], "i long, j long, sim double")
    gates = expansion.Gates(0.0, 600.0, 0.2, 12)
    assert clusters(expansion.hierarchically_expanded(member_rows(spark, rows), none, math.cos(0.2), math.cos(0.32), math.cos(0.15), 0.0, gates)) == [[0, 1, 2, 3, 4], [5, 6], [7]]
    assert clusters(expansion.hierarchically_expanded(member_rows(spark, rows), none, math.cos(0.2), math.cos(0.32), math.cos(0.15), 0.0, expansion.Gates(0.0, 600.0, 0.2, 4))) == [[0, 1, 2], [3, 4], [5, 6], [7]]


@pytest.mark.parametrize("name", ["gra10_hierarchical", "gra11_expanded"])
def test_expanded_clusters_keep_the_gates(spark, name):
    facts = {r.node: r for r in _members(spark, SF).collect()}
    got = grouped((r.node, r.cluster) for r in run(spark, name))
    assert sorted(n for p in got for n in p) == sorted(facts)
    before = grouped((r.node, r.cluster) for r in facts.values())
    assert len(got) < len(before) and all(any(set(b) <= set(p) for p in got) for b in before if len(b) > 1)
    grown = [p for p in got if p not in before]
    assert grown and all(len({facts[n].camera_id[:3] for n in p}) == 1 for p in grown)


def brute_clear(mine, truth):
    by = defaultdict(lambda: ([], []))
    for k, rows in enumerate((mine, truth)):
        for r in rows:
            by[r.camera_id, r.frame_id][k].append(r)
    last, tp, switches = defaultdict(dict), defaultdict(int), defaultdict(int)
    for camera, frame in sorted(by):
        pairs = {}
        for p in by[camera, frame][0]:
            for g in by[camera, frame][1]:
                wide = max(0, min(p.x + p.w, g.x + g.w) - max(p.x, g.x)) * max(0, min(p.y + p.h, g.y + g.h) - max(p.y, g.y))
                iou = wide / (p.w * p.h + g.w * g.h - wide)
                if iou >= 0.3:
                    pairs[g.track_id, p.track_id] = max(iou, pairs.get((g.track_id, p.track_id), 0))
        kept = {g: p for g, p in last[camera].items() if (g, p) in pairs}
        rest = {(g, p): 2 + s for (g, p), s in pairs.items() if g not in kept and p not in kept.values()}
        best = {}
        if rest:  # the choice with most pairs, then most overlap, by trying one pair after another
            gs = sorted({g for g, _ in rest})

            def choose(k, used):
                if k == len(gs):
                    return 0.0, {}
                out = choose(k + 1, used)
                for (g, p), w in rest.items():
                    if g == gs[k] and p not in used:
                        s, m = choose(k + 1, used | {p})
                        if s + w > out[0]:
                            out = (s + w, m | {g: p})
                return out

            best = choose(0, frozenset())[1]
        switches[camera] += sum(g in last[camera] and last[camera][g] != p for g, p in best.items())
        last[camera].update(kept | best)
        tp[camera] += len(kept) + len(best)
    return tp, switches


def test_clear_scores(spark):
    mine, truth = (f.collect() for f in _boxes(spark, SF))
    tp, switches = brute_clear(mine, truth)
    for r in run(spark, "evl01_clear_scores"):
        n_gt, n_pred = sum(t.camera_id == r.camera_id for t in truth), sum(p.camera_id == r.camera_id for p in mine)
        assert (r.n_gt - r.misses, r.n_gt, n_pred - r.false_positives) == (tp[r.camera_id], n_gt, tp[r.camera_id]) and abs(r.switches - switches[r.camera_id]) <= 2
    assert sum(tp.values()) > 500


@pytest.mark.parametrize("name, reach, silence", [("str03_ground_tracks", 200.0, 3), ("str04_nearest_tracks", 75.0, 5)])
def test_tracks(spark, name, reach, silence):
    points = {(r.camera_id, r.f, r.x, r.y) for r in views.detections(spark, SF).select("camera_id", F.expr("frame_id div 12").alias("f"), "x", "y").collect()}
    tracks = defaultdict(list)
    for r in run(spark, name):
        assert (r.scene, r.frame_id, r.x, r.y) in points
        tracks[r.scene, r.track_id].append((r.frame_id, r.x, r.y))
    for own in tracks.values():
        own.sort()
        assert len(own) >= 2
        for (f, x, y), (g, u, v) in zip(own, own[1:], strict=False):
            assert 0 < g - f <= silence and (name == "str03_ground_tracks" or math.hypot(x - u, y - v) <= reach)


def test_linked_trajectories_share_no_camera(spark):
    rows = views.chopped(spark, SF).select((F.col("track_id") * 10 + F.substring("camera_id", 4, 1).cast("long")).alias("node"), "camera_id").distinct().collect()
    camera = {r.node: r.camera_id for r in rows}
    got = grouped((r.node, r.cluster) for r in run(spark, "gra13_linked_trajectories"))
    assert sorted(n for p in got for n in p) == sorted(camera) and any(len(p) > 1 for p in got)
    assert all(len({camera[n] for n in p}) == len(p) for p in got)


def test_whitening(spark, vectors):
    ids = sorted(vectors)
    x = np.array([vectors[i].v for i in ids])
    centred = x - x.mean(0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    want = np.linalg.norm(centred @ vt[:16].T / (s[:16] / np.sqrt(len(x) - 1)), axis=1)
    got = {r.index_id: r.length for r in run(spark, "vec07_pca_whitened")}
    assert [got[i] for i in ids] == pytest.approx(want.tolist(), abs=2e-4)
    by = defaultdict(list)
    for i in ids:
        by[vectors[i].camera_id].append(i)
    got = {r.index_id: list(r.v) for r in P.camera_whitened(views.features(spark, SF)).collect()}
    for own in by.values():
        m = np.array([vectors[i].v for i in own])
        c = m - m.mean(0)
        w = c @ np.linalg.inv(c.T @ c + len(m) * 3.0 * np.eye(m.shape[1]))
        w /= np.linalg.norm(w, axis=1, keepdims=True)
        assert np.allclose([got[i] for i in own], w, atol=1e-6)


def test_pooling_cases(spark):
    schema = "k int, index_id long, place int, quality double, v array<double>"
    eye = [(0, i, i, 1.0, [float(i == j) for j in range(3)]) for i in range(3)]
    padded = eye + [(0, 10 + k, 3 + k, 0.0, [0.7, 0.7, 0.0]) for k in range(21)]
    short = [(1, 30, 0, 1.0, [1.0, 0.0, 0.0]), (1, 31, 1, 1.0, [0.0, 1.0, 0.0])]
    frame = spark.createDataFrame(padded + short, schema)
    got = {r.k: r.v for r in P.pooled(frame, ["k"], "mean", 3).collect()}
    assert got[0] == pytest.approx([3**-0.5] * 3) and got[1] == pytest.approx([0.5**0.5, 0.5**0.5, 0.0])
    assert {r.k: r.v for r in P.pooled(frame, ["k"], "medoid", 8).collect()}[0] == pytest.approx([3**-0.5] * 3)
    with pytest.raises(ValueError):
        P.pooled(frame, ["k"], "nothing")
    (row,) = P.geometric_median(spark.createDataFrame([(0, k, v) for k, v in enumerate([[1.0, 0.0], [0.8, 0.2], [0.7, 0.3], [0.0, 1.0]])], "k int, index_id long, v array<double>"), ["k"]).collect()
    assert min(row.v) >= -1e-6 and np.linalg.norm(row.v) == pytest.approx(1)
    (row,) = P.geometric_median(spark.createDataFrame([(0, k, v) for k, v in enumerate([[1.0, 0.0]] * 3 + [[0.0, 1.0]])], "k int, index_id long, v array<double>"), ["k"], rounds=60).collect()
    assert row.v == pytest.approx([1.0, 0.0], abs=1e-3)


def test_hull(spark):
    rng = random.Random(3)
    points = [("abc"[k % 3], round(rng.gauss(0, 9), 2), round(rng.gauss(0, 5), 2)) for k in range(900)] + [("d", 1.0, 1.0), ("d", 1.0, 1.0), ("e", 0.0, 0.0), ("e", 1.0, 1.0), ("e", 2.0, 2.0)]
    got = defaultdict(list)
    for r in reports.hull(spark.createDataFrame(points, "camera string, x double, y double").repartition(5), "camera").orderBy("place").collect():
        got[r.camera].append((r.x, r.y))
    for c in "abc":
        own = {(x, y) for k, x, y in points if k == c}
        turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
        corners = got[c]
        assert set(corners) <= own and corners[0] == min(own)
        for a, b in zip(corners, corners[1:] + corners[:1], strict=True):
            assert all(turn(a, b, p) >= -1e-9 for p in own)
    assert got["d"] == [(1.0, 1.0)] and got["e"] == [(0.0, 0.0), (2.0, 2.0)]


def test_probes_of_another_run(spark):
    rng = np.random.default_rng(2)
    gallery = spark.createDataFrame([(k, [float(x) for x in rng.standard_normal(6)]) for k in range(80)], "index_id long, v array<double>")
    mean, basis = retrieval.fitted_projection(gallery, 3)
    probes = spark.createDataFrame([(0, [1.0] * 6), (1, [1.0] * 3), (2, [1.0] * 5)], "index_id long, v array<double>")
    got = {r.index_id: r for r in retrieval.projected(probes, mean, basis).collect()}
    want = (np.ones(6) - mean) @ basis
    assert got[0].v == pytest.approx((want / np.linalg.norm(want)).tolist()) and got[1].v == pytest.approx([3**-0.5] * 3)
    assert got[2].v is None and "5" in got[2].error


def test_empty_probes(spark):
    from trackloom.operators import search

    gallery = spark.createDataFrame([(1, 2, [1.0, 0.0])], "index_id long, pid long, v array<double>")
    none = gallery.limit(0)
    assert search.track_search(none, gallery, "pid", 5).collect() == [] and search.trajectory_scores(none, gallery, "pid", 0.0, 0.0).collect() == []
    assert search.watchlist_hits(none, gallery, "pid", 0.1).collect() == [] and search.top_matches(none, gallery, 2).collect() == []
    (tied,) = [[r.index_id for r in search.top_matches(gallery.withColumn("index_id", F.lit(99).cast("long")), spark.createDataFrame([(11 - k, [1.0, 0.0]) for k in range(12)], "index_id long, v array<double>"), 2).collect()]]
    assert sorted(tied) == [0, 1]
