"""Searches of probe vectors in a gallery (index_id, v array<double>). Probes are a stated query set:
the probe matrix is small and checked against MAX_PROBES; the gallery streams past it in tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.scoring import alert_level

#: Probes compared in one pass; more are searched in several.
MAX_PROBES = 20_000
#: Pairs that a task holds at once, about.
MAX_PAIRS = 1 << 20


class Best:
    """The k best columns of each of n rows so far, by similarity to twelve digits, then id. Copies of a vector
    thus tie, wherever they stand in a product."""

    def __init__(self, n: int, k: int):
        self.sims, self.ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, first: int, sims: np.ndarray, ids: np.ndarray) -> None:
        """Takes sims of the rows from `first` on and the columns ids; pairs that don't count are -inf."""
        rows, k = np.arange(first, first + len(sims)), self.ids.shape[1]
        least = self.sims[rows, -1]
        if k < sims.shape[1] and np.isinf(least).any():
            least = np.maximum(least, np.partition(sims, -k, axis=1)[:, -k])
        a, b = np.nonzero((sims >= least[:, None] - 1e-11) & (sims > -np.inf))
        if not len(a):
            return
        met = np.unique(a)
        row = np.concatenate([np.repeat(met, k), a])
        sim = np.concatenate([self.sims[rows[met]].ravel(), np.round(sims[a, b], 12)])
        own = np.concatenate([self.ids[rows[met]].ravel(), ids[b]])
        order = np.lexsort((own, -sim, row))
        kept = order[np.searchsorted(row[order], met)[:, None] + np.arange(k)]
        self.sims[rows[met]], self.ids[rows[met]] = sim[kept], own[kept]

    def table(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(name, id, sim) of what is held, a name for each row."""
        held = self.sims > -np.inf
        return np.repeat(names, held.sum(1)), self.ids[held], self.sims[held]


def _probe_blocks(probes: DataFrame, block: int = MAX_PROBES, *, spaces: tuple[str, ...] = ("v",)):
    """(ids, matrix, ...) of the probes, MAX_PROBES at a time, with a matrix for each column of vectors."""
    n = probes.count()
    parts = max(1, -(-n // block))
    for k in range(parts):
        own = probes if parts == 1 else probes.where(F.pmod(F.xxhash64("index_id"), F.lit(parts)) == k)
        rows = own.select("index_id", *spaces).collect()
        if rows:
            yield np.array([r.index_id for r in rows]), *[np.array([r[c] for r in rows]) for c in spaces]


def top_matches(probes: DataFrame, gallery: DataFrame, k: int, min_similarity: float = -2.0, exclude_self: bool = False) -> DataFrame:
    """(probe_id, index_id, sim, place): the k best gallery rows of each probe; ties by id. A task keeps
    its own k best for each probe, so at most k rows for each probe and task are shuffled."""
    found = None
    for ids, matrix in _probe_blocks(probes):

        def run(batches, ids=ids, matrix=matrix, step=max(1, MAX_PAIRS // len(ids))):
            best = Best(len(ids), k)
            for batch in batches:
                for at in range(0, len(batch), step):
                    part = batch.iloc[at : at + step]
                    own = part["index_id"].to_numpy()
                    sims = matrix @ np.stack(part["v"].to_numpy()).T
                    sims[sims < min_similarity] = -np.inf
                    if exclude_self:
                        sims[ids[:, None] == own[None, :]] = -np.inf
                    best.add(0, sims, own)
            yield pd.DataFrame(dict(zip(("probe_id", "index_id", "sim"), best.table(ids), strict=True)))

        part = gallery.select("index_id", "v").mapInPandas(run, "probe_id long, index_id long, sim double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = gallery.sparkSession.createDataFrame([], "probe_id long, index_id long, sim double")
    w = Window.partitionBy("probe_id").orderBy(F.desc("sim"), "index_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def all_matches(probes: DataFrame, gallery: DataFrame, exclude_self: bool = False) -> DataFrame:
    """(probe_id, index_id, sim) of every probe and gallery row. A task keeps nothing between its parts of
    MAX_PAIRS."""
    return space_matches(probes, gallery, ("v",), exclude_self).withColumnRenamed("v", "sim")


def space_matches(probes: DataFrame, gallery: DataFrame, spaces: tuple[str, ...], exclude_self: bool = False) -> DataFrame:
    """(probe_id, index_id, ...) of every probe and gallery row with their product in each of several columns of
    vectors, under the column's name. The products of a pair are made together, so that they needn't be joined."""
    schema = "probe_id long, index_id long" + "".join(f", {c} double" for c in spaces)
    found = None
    for ids, *matrices in _probe_blocks(probes, spaces=spaces):

        def run(batches, ids=ids, matrices=matrices, step=max(1, MAX_PAIRS // len(ids))):
            for batch in batches:
                for k in range(0, len(batch), step):
                    part = batch.iloc[k : k + step]
                    sims = {c: (m @ np.stack(part[c].to_numpy()).T).ravel() for c, m in zip(spaces, matrices, strict=True)}
                    out = pd.DataFrame({"probe_id": np.repeat(ids, len(part)), "index_id": np.tile(part["index_id"].to_numpy(), len(ids))} | sims)
                    yield out[out["probe_id"] != out["index_id"]] if exclude_self else out

        part = gallery.select("index_id", *spaces).mapInPandas(run, schema)
        found = part if found is None else found.unionByName(part)
    return gallery.sparkSession.createDataFrame([], schema) if found is None else found


def best_per_group(probes: DataFrame, gallery: DataFrame, group: str) -> DataFrame:
    """(probe_id, group, best): each probe's largest similarity in each gallery group. Tasks reduce their
    rows to one for each probe and group."""
    found = None
    for ids, matrix in _probe_blocks(probes):

        def run(batches, ids=ids, matrix=matrix):
            for part in batches:
                if len(part):
                    sims = pd.DataFrame((matrix @ np.stack(part["v"].to_numpy()).T).T, columns=ids).groupby(part[group].to_numpy()).max()
                    yield sims.rename_axis(group).reset_index().melt(group, var_name="probe_id", value_name="best").astype({"probe_id": "int64"})

        kind = dict(gallery.dtypes)[group]
        part = gallery.select(group, "v").mapInPandas(run, f"{group} {kind}, probe_id long, best double")
        found = part if found is None else found.unionByName(part)
    if found is None:  # no probe
        found = gallery.sparkSession.createDataFrame([], f"{group} {dict(gallery.dtypes)[group]}, probe_id long, best double")
    return found.groupBy("probe_id", group).agg(F.max("best").alias("best"))


def track_search(probes: DataFrame, gallery: DataFrame, group: str, k: int) -> DataFrame:
    """(group, score, place): groups by the mean over probes of the best similarity; k within 1..200."""
    scores = best_per_group(probes, gallery, group).groupBy(group).agg(F.avg("best").alias("score"))
    top = scores.orderBy(F.desc("score"), group).limit(max(1, min(200, k)))
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), group)))


def trajectory_scores(probes: DataFrame, gallery: DataFrame, group: str, mean_gate: float, low_gate: float) -> DataFrame:
    """(group, mean, p25): groups whose mean and 25th percentile of the best similarities pass the gates."""
    best = best_per_group(probes, gallery, group)
    return best.groupBy(group).agg(F.avg("best").alias("mean"), F.percentile("best", 0.25).alias("p25")).where((F.col("mean") >= mean_gate) & (F.col("p25") >= low_gate))


def watchlist_hits(watchlist: DataFrame, gallery: DataFrame, group: str, threshold: float, confidence: float = 1.0) -> DataFrame:
    """(probe_id, group, best, level): watched vectors' largest similarity to each group from the threshold
    on, with the alert level."""
    hits = best_per_group(watchlist, gallery, group).where(F.col("best") >= threshold)
    return hits.withColumn("level", alert_level(F.col("best"), F.lit(confidence)))
