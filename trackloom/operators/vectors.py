"""Pooling, normalising and whitening of vectors (v array<double>)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.vectors import dot, normalized, squared_distance
from trackloom.tables import written


def _collected(long: DataFrame, keys: list[str], value: str, unit: bool) -> DataFrame:
    """Vectors of long rows (keys, dim, value)."""
    out = long.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", value))), lambda s: s[value]).alias("v"))
    return out.withColumn("v", normalized("v")) if unit else out


def partial_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, weight, v): sums of weights and weighted vectors (keys, v, weight), one row for each key of a
    task's batch, so that a large group is small before it is shuffled."""
    kinds = dict(rows.dtypes)

    def run(batches):
        for part in batches:
            part = part[part["v"].notna()]
            for _, same in part.groupby(part["v"].map(len)):  # vectors of one length
                of = same.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
                codes, first = np.unique(of, return_index=True)
                weight = same["weight"].to_numpy(dtype=float)
                total = np.zeros((len(codes), len(same["v"].iloc[0])))
                np.add.at(total, of, np.stack(same["v"].to_numpy()) * weight[:, None])
                out = same.iloc[first][keys].reset_index(drop=True)
                yield out.assign(weight=np.bincount(of, weights=weight, minlength=len(codes)), v=list(total))

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", weight double, v array<double>"
    return rows.select(*keys, F.col("weight").cast("double").alias("weight"), "v").mapInPandas(run, schema)


def summed(rows: DataFrame, keys: list[str], unit: bool = False) -> DataFrame:
    """(keys, v): the weighted sum of vectors (keys, v, weight), component by component."""
    long = partial_sums(rows, keys).select(*keys, F.posexplode("v").alias("dim", "x"))
    return _collected(long.groupBy(*keys, "dim").agg(F.sum("x").alias("s")), keys, "s", unit)


def few_summed(rows: DataFrame, keys: list[str], unit: bool = False) -> DataFrame:
    """As summed, for keys that have few rows each, such as a row's k neighbours: vectors are collected by
    key and added up, in one shuffle."""
    held = rows.groupBy(*keys).agg(F.collect_list(F.struct("weight", "v")).alias("s"))
    first = F.transform(F.col("s")[0]["v"], lambda x: x * F.col("s")[0]["weight"])
    rest = F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(1)))
    out = held.withColumn("v", F.aggregate(F.when(F.size("s") > 1, rest).otherwise(F.slice("s", 1, 0)), first, lambda t, x: F.zip_with(t, x["v"], lambda a, b: a + b * x["weight"])))
    out = out.drop("s")
    return out.withColumn("v", normalized("v")) if unit else out


def mean_pooled(rows: DataFrame, keys: list[str], unit: bool = True) -> DataFrame:
    long = partial_sums(rows.withColumn("weight", F.lit(1.0)), keys).select(*keys, "weight", F.posexplode("v").alias("dim", "x"))
    return _collected(long.groupBy(*keys, "dim").agg((F.sum("x") / F.sum("weight")).alias("s")), keys, "s", unit)


def median_pooled(rows: DataFrame, keys: list[str], unit: bool = True) -> DataFrame:
    long = rows.select(*keys, F.posexplode("v").alias("dim", "x"))
    return _collected(long.groupBy(*keys, "dim").agg(F.median("x").alias("s")), keys, "s", unit)


def quality_pooled(rows: DataFrame, keys: list[str], temperature: float = 3.0, unit: bool = True) -> DataFrame:
    """The mean weighted by the softmax of temperature * quality, shifted by its maximum."""
    w = Window.partitionBy(*keys)
    e = F.exp(temperature * (F.col("quality") - F.max("quality").over(w)))
    weighted = rows.withColumn("e", e).withColumn("weight", F.col("e") / F.sum("e").over(w))
    return summed(weighted.select(*keys, "v", "weight"), keys, unit)


def trimmed_pooled(rows: DataFrame, keys: list[str], share: float, unit: bool = True) -> DataFrame:
    """The mean of the vectors closest to the mean, without floor(share * n) of them."""
    centre = mean_pooled(rows, keys).withColumnRenamed("v", "centre")
    w = Window.partitionBy(*keys)
    ranked = rows.join(centre, keys).withColumn("sim", dot(normalized("v"), "centre"))
    ranked = ranked.withColumns({"n": F.count("*").over(w), "r": F.row_number().over(w.orderBy(F.desc("sim"), "index_id"))})
    return mean_pooled(ranked.where(F.col("r") <= F.col("n") - F.floor(F.col("n") * share)), keys, unit)


def medoid(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, index_id): the row with the largest sum of cosines to its group. The sum is a product with
    the sum of the group's unit vectors, so no pair is built."""
    unit = rows.withColumn("u", normalized("v"))
    total = summed(unit.select(*keys, F.col("u").alias("v"), F.lit(1.0).alias("weight")), keys).withColumnRenamed("v", "total")
    scored = unit.join(total, keys).withColumn("sim", dot("u", "total"))
    return scored.groupBy(*keys).agg(F.max_by("index_id", F.struct(F.round("sim", 9), (-F.col("index_id")).alias("i"))).alias("index_id"))


def standardized_by(rows: DataFrame, camera: str = "camera_id", min_rows: int = 5, eps: float = 1e-8) -> DataFrame:
    """Vectors less the mean over the deviation (ddof 0) of their camera; cameras with fewer rows, and
    tables of one camera, use those of all rows."""
    long = rows.select("index_id", camera, F.posexplode("v").alias("dim", "x"))
    own = long.groupBy(camera, "dim").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    every = long.groupBy("dim").agg(F.avg("x").alias("m_all"), F.stddev_pop("x").alias("s_all"), F.count_distinct(camera).alias("cameras"))
    stats = own.join(every, "dim")
    use = (F.col("n") >= min_rows) & (F.col("cameras") > 1)
    stats = stats.select(camera, "dim", F.when(use, F.col("m")).otherwise(F.col("m_all")).alias("m"), F.when(use, F.col("s")).otherwise(F.col("s_all")).alias("s"))
    scaled = long.join(stats, [camera, "dim"]).withColumn("z", (F.col("x") - F.col("m")) / (F.col("s") + eps))
    return _collected(scaled, ["index_id", camera], "z", unit=False)


def second_moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, covariance) of the vectors, from partial sums of each task; dims**2 numbers each."""

    def run(batches):
        n, s, g = 0, None, None
        for part in batches:
            if len(part):
                m = np.stack(part["v"].to_numpy())
                n, s, g = n + len(m), m.sum(0) + (0 if s is None else s), m.T @ m + (0 if g is None else g)
        if n:
            yield pd.DataFrame({"n": [n], "s": [s], "g": [g.ravel()]})

    parts = rows.select("v").mapInPandas(run, "n long, s array<double>, g array<double>")
    long = parts.select("n", "s", F.posexplode("g").alias("at", "x"))
    gram = np.array([r.x for r in long.groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()])
    sums = [r.x for r in parts.select(F.posexplode("s").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()]
    n = parts.agg(F.sum("n")).first()[0] or 0
    mean = np.array(sums) / max(n, 1)
    return n, mean, gram.reshape(len(mean), len(mean)) / max(n, 1) - np.outer(mean, mean)


def pca_whitened(rows: DataFrame, components: int, eps: float = 1e-12) -> DataFrame:
    """(index_id, v): projections on the leading components with unit variance (ddof 1). Signs make
    each component's largest entry positive."""
    n, mean, cov = second_moments(rows)
    value, vector = np.linalg.eigh(cov * n / max(n - 1, 1))
    order = np.argsort(-value)[: min(components, n, len(mean))]
    basis = vector[:, order] * np.sign(vector[np.abs(vector[:, order]).argmax(0), order])
    basis = basis / np.sqrt(np.maximum(value[order], eps))

    def run(batches):
        for part in batches:
            if len(part):
                out = (np.stack(part["v"].to_numpy()) - mean) @ basis
                yield pd.DataFrame({"index_id": part["index_id"], "v": list(out)})

    return rows.select("index_id", "v").mapInPandas(run, "index_id long, v array<double>")


def camera_whitened(rows: DataFrame, ridge: float = 3.0, min_rows: int = 5) -> DataFrame:
    """(index_id, v): (C^T C + n * ridge * I)^-1 applied to vectors centred by camera, unit length;
    cameras with fewer rows are left alone. A camera's moments come from partial sums (dims**2
    numbers), not from its rows in one task."""

    def partial(batches):
        held: dict[str, list] = {}
        for part in batches:
            for camera, own in part.groupby("camera_id"):
                m = np.stack(own["v"].to_numpy())
                got = held.setdefault(camera, [0, 0.0, 0.0])
                got[0], got[1], got[2] = got[0] + len(m), got[1] + m.sum(0), got[2] + m.T @ m
        if held:
            yield pd.DataFrame([{"camera_id": c, "n": n, "s": s, "g": g.ravel()} for c, (n, s, g) in held.items()])

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        n, s = int(part["n"].sum()), np.sum(np.stack(part["s"].to_numpy()), 0)
        d = len(s)
        gram = np.sum(np.stack(part["g"].to_numpy()), 0).reshape(d, d) - np.outer(s, s) / n
        inverse = np.linalg.inv(gram + n * ridge * np.eye(d))
        return pd.DataFrame([{"camera_id": part["camera_id"].iloc[0], "n": n, "mean": s / n, "inverse": inverse.ravel()}])

    moments = rows.select("camera_id", "v").mapInPandas(partial, "camera_id string, n long, s array<double>, g array<double>")
    solved = moments.groupBy("camera_id").applyInPandas(solve, "camera_id string, n long, mean array<double>, inverse array<double>")

    def apply(batches):
        for part in batches:
            for _, own in part.groupby("camera_id"):
                m = np.stack(own["v"].to_numpy())
                if own["n"].iloc[0] >= min_rows:
                    d = m.shape[1]
                    m = (m - own["mean"].iloc[0]) @ np.asarray(own["inverse"].iloc[0]).reshape(d, d).T
                    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-8)
                yield pd.DataFrame({"index_id": own["index_id"], "v": list(m)})

    return rows.select("index_id", "camera_id", "v").join(solved, "camera_id").mapInPandas(apply, "index_id long, v array<double>")


def geometric_median(rows: DataFrame, keys: list[str], rounds: int = 20, eps: float = 1e-6) -> DataFrame:
    """(keys, v): Weiszfeld's iteration over unit vectors from their mean, of unit length. A group is done
    when a row is nearer than eps to the estimate, which then is that row (the first by index_id), when
    a step is shorter than eps, or after the given rounds. Each round is a join and a sum."""
    unit = written(rows.select(*keys, "index_id", normalized("v").alias("v")))
    now = mean_pooled(unit, keys, unit=False).withColumn("done", F.lit(False))
    far = F.sqrt(squared_distance("v", "c"))
    for _ in range(rounds):
        now = written(now)
        todo = now.where("not done").select(*keys, F.col("v").alias("c"))
        if todo.isEmpty():
            break
        placed = unit.join(todo, keys).withColumn("far", far)
        hit = placed.where(F.col("far") < eps).groupBy(*keys).agg(F.min_by("v", "index_id").alias("hit"))
        weighted = partial_sums(placed.withColumn("weight", 1 / F.greatest("far", F.lit(eps))), keys)
        long = weighted.select(*keys, "weight", F.posexplode("v").alias("dim", "x"))
        new = _collected(long.groupBy(*keys, "dim").agg((F.sum("x") / F.sum("weight")).alias("s")), keys, "s", unit=False).withColumnRenamed("v", "new")
        step = now.join(new, keys, "left").join(hit, keys, "left")
        still = F.coalesce(F.sqrt(squared_distance("v", "new")) < eps, F.lit(True)) | F.col("hit").isNotNull()
        now = step.select(*keys, F.when(F.col("done"), F.col("v")).otherwise(F.coalesce("hit", "new")).alias("v"), (F.col("done") | still).alias("done"))
    return now.select(*keys, normalized("v").alias("v"))


def trimmed_suffix(rows: DataFrame, keys: list[str], at: str = "place", atol: float = 1e-6) -> DataFrame:
    """Rows of each key without the padding at the end: the last vector and all equal to it right before it
    (component by component within atol), where these are two or more; the first row stays."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at))
    same = F.aggregate(F.zip_with("v", F.first("v").over(w), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: F.greatest(s, x)) <= atol
    marked = rows.withColumn("same", same)
    run = F.min(F.col("same").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    padded = marked.withColumn("run", run).withColumn("padding", F.sum("run").over(Window.partitionBy(*keys)))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(at)) == 1
    return padded.withColumn("first", first).where((F.col("run") == 0) | (F.col("padding") <= 1) | F.col("first")).drop("same", "run", "padding", "first")


def top_pooled(rows: DataFrame, keys: list[str], k: int = 12, around: str = "mean") -> DataFrame:
    """(keys, v): the mean of the k vectors closest to the group's mean, or to its medoid."""
    unit = rows.select(*keys, "index_id", normalized("v").alias("v"))
    if around == "mean":
        centre = mean_pooled(unit, keys).withColumnRenamed("v", "c")
    else:
        centre = unit.join(medoid(unit, keys), [*keys, "index_id"]).select(*keys, F.col("v").alias("c"))
    w = Window.partitionBy(*keys).orderBy(F.desc("sim"), "index_id")
    near = unit.join(centre, keys).withColumn("sim", F.round(dot("v", "c"), 9)).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return mean_pooled(near.select(*keys, "v"), keys)


#: Names of the pooling modes.
POOLS = {
    "mean": mean_pooled,
    "median": lambda rows, keys: median_pooled(rows.withColumn("v", normalized("v")), keys),
    "geo_median": geometric_median,
    "geometric_median": geometric_median,
    "medoid": lambda rows, keys: rows.join(medoid(rows, keys), [*keys, "index_id"]).select(*keys, normalized("v").alias("v")),
    "trimmed_mean_10": lambda rows, keys: trimmed_pooled(rows, keys, 0.10),
    "trimmed_mean_25": lambda rows, keys: trimmed_pooled(rows, keys, 0.25),
    "top12_to_mean": lambda rows, keys: top_pooled(rows, keys, 12, "mean"),
    "top12_to_medoid": lambda rows, keys: top_pooled(rows, keys, 12, "medoid"),
}


def pooled(rows: DataFrame, keys: list[str], mode: str, min_k: int = 3) -> DataFrame:
    """(keys, v): vectors (keys, index_id, place, quality, v) pooled by a mode of POOLS after padding is cut;
    groups with fewer than min_k rows fall back to the mean weighted by quality. An unknown mode is an
    error."""
    if mode not in POOLS:
        raise ValueError(f"unknown pooling mode {mode}: one of {', '.join(POOLS)}")
    own = trimmed_suffix(rows, keys).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    few = quality_pooled(own.where(F.col("n") < min_k).withColumn("v", normalized("v")), keys)
    return POOLS[mode](own.where(F.col("n") >= min_k).drop("n"), keys).unionByName(few)


def top_crops(rows: DataFrame, means: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, crops): the k vectors of best quality (ties by index_id), filled up with the key's pooled
    vector of means (keys, v)."""
    w = Window.partitionBy(*keys).orderBy(F.desc("quality"), "index_id")
    best = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    lists = best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda s: s["v"]).alias("crops"))
    whole = lists.join(means.select(*keys, "v"), keys)
    return whole.select(*keys, F.concat("crops", F.array_repeat("v", F.lit(k) - F.size("crops"))).alias("crops"))


def flattened_queries(rows: DataFrame, keys: list[str], queries: str = "queries") -> DataFrame:
    """(keys, place, v): the vectors of a query tensor as rows."""
    return rows.select(*keys, F.posexplode(queries).alias("place", "v"))


def restored_queries(flat: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, queries): the vectors of each key in order of place."""
    return flat.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda s: s["v"]).alias("queries"))


def uniform_queries(rows: DataFrame, keys: list[str], queries: str = "queries") -> DataFrame:
    """The rows, where every tensor must have the same number of vectors of the same length; others are an
    error when they are read."""
    shape = F.struct(F.size(queries).alias("k"), F.array_max(F.transform(queries, lambda v: F.size(v))).alias("d"), F.array_min(F.transform(queries, lambda v: F.size(v))).alias("e"))
    first = rows.agg(F.min(shape).alias("s")).select("s.*").first()
    ok = (F.size(queries) == F.lit(first["k"])) & F.forall(queries, lambda v: F.size(v) == F.lit(first["d"]))
    return rows.withColumn(queries, F.when(ok, F.col(queries)).otherwise(F.raise_error(F.lit("query tensors differ in shape"))))


def weighted_histogram(rows: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """(keys, v): histograms (keys, quality, v) averaged by quality, of unit length; zeros where no quality is
    above 0."""
    total = summed(rows.withColumn("weight", F.col("quality").cast("double")), keys)
    sized = F.sqrt(dot("v", "v"))
    unit = F.when(sized > 0, F.transform("v", lambda x: x / sized)).otherwise(F.array_repeat(F.lit(0.0), bins))
    return total.select(*keys, unit.alias("v"))


def embedding_bank(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, v): mean vectors of unit length; keys whose mean is zero are left out."""
    means = mean_pooled(rows, keys, unit=False).where(dot("v", "v") > 0)
    return means.select(*keys, normalized("v").alias("v"))


def mean_pair_cosine(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mean, pairs): the mean cosine over all pairs of a key's vectors. The sum over pairs is half of
    the squared length of the sum of unit vectors, less the rows, so no pair is built."""
    unit = rows.select(*keys, normalized("v").alias("v"), F.lit(1.0).alias("weight"))
    n = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    total = summed(unit, keys).join(n, keys).withColumn("pairs", F.expr("n * (n - 1) div 2"))
    return total.select(*keys, ((dot("v", "v") - F.col("n")) / 2 / F.col("pairs")).alias("mean"), "pairs")
