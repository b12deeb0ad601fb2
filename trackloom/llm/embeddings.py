"""Near-duplicate vectors: random-hyperplane sign hashes in several tables propose pairs inside a
bucket, cosines are verified exactly in double precision, and links are closed into components.

Equal vectors of a label are collapsed first. Bits and tables are planned for each label by its number of
distinct vectors, so that buckets hold about BUCKET of them whatever the label's share. A bucket is dealt
into blocks of at most about BLOCK vectors, and pairs of blocks are compared in separate groups as
matrix products; out of a group come numbers of links for each vector and a spanning star for each
local component, never the pairs. A pair that meets in several tables counts in the first one. Vectors
travel in the precision that they came in.

Only vectors with equal, non-null labels and equal lengths are compared. Vectors that are null, empty
or zero, or hold null or non-finite components, link with nothing. Repeated rows are vectors of their
own that link with each other. An empty table gives an empty result. Copies are told apart from
other vectors by a 64-bit hash of label and components."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm import _text
from trackloom.operators.components import components

#: Vectors that a bucket holds, about, and vectors of a bucket that are compared by one matrix product.
BUCKET, BLOCK = 128, 256
#: Rows of small buckets that one group of the comparison gets, about.
GROUP_ROWS = 20_000
#: Labels up to which their sizes are broadcast; beyond, they are joined.
MAX_LABELS = 200_000


def plan_tables(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits, tables) for a label of n vectors: buckets of about BUCKET vectors, and as many tables as find
    a pair at the threshold with the given probability."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = min(60, max(1, round(math.log2(max(2, n / BUCKET)))))
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree**bits)))


def sign_codes(matrix: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """The code of each vector in each table: the signs of its products with random normals."""
    planes = np.random.default_rng(seed).standard_normal((matrix.shape[1], tables * bits))
    signs = (matrix @ planes > 0).reshape(len(matrix), tables, bits)
    return signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def cosines(matrix: np.ndarray) -> np.ndarray:
    """Cosines of all pairs of rows, in double precision; rows are scaled by powers of two, which is exact."""
    rows = matrix.astype(np.float64)
    rows = np.ldexp(rows, -np.frexp(np.abs(rows).max(1, keepdims=True))[1])
    norms = np.sqrt((rows * rows).sum(1))
    return rows @ rows.T / (norms[:, None] * norms[None, :])


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of 0..n-1 by links a-b."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if np.array_equal(new, low):
            return low
        low = new


def _label_sizes(sizes: DataFrame) -> list:
    """(n, rows): rows of labels whose size, rounded up to a power of two, is n."""
    power = F.pow(F.lit(2.0), F.ceil(F.log2("n_label")))
    return sizes.groupBy(power.alias("n")).agg(F.sum("n_label").alias("rows")).collect()  # at most 64 rows


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    recall: float = 0.9999,
    seed: int = 7,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row. `recall` is the least probability that a
    pair at the threshold shares a bucket; pairs above it are likelier."""
    single = dict(vectors.dtypes)[vector_col] == "array<float>"
    plain = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    rid = F.when(valid, F.xxhash64(F.col("label").cast("string"), "vector"))
    plain = plain.withColumn("rid", rid)
    kept_as = F.col("vector").cast("array<float>" if single else "array<double>").alias("vector")
    reps = _text.written(
        plain.where(valid).groupBy("rid", F.col("label").cast("string").alias("label"), kept_as).agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    )
    sizes = _text.written(reps.groupBy("label").agg(F.count("*").alias("n_label")))
    sized = reps.join(F.broadcast(sizes) if sizes.count() <= MAX_LABELS else sizes, "label")
    kind = np.float32 if single else np.float64

    def coded(batches):
        for part in batches:
            plans = {n: plan_tables(n, threshold, recall) for n in part["n_label"].unique()}
            for (dim, (bits, tables)), same in part.groupby([part["vector"].map(len), part["n_label"].map(plans)]):
                matrix = np.stack(same["vector"].to_numpy()).astype(np.float64)
                codes = sign_codes(matrix, bits, tables, seed + dim + (bits << 32))
                small = codes.astype(np.min_scalar_type((1 << bits) - 1))
                for t in range(tables):
                    yield pd.DataFrame(
                        {
                            "label": same["label"].to_numpy(),
                            "dim": dim,
                            "at": t,
                            "code": codes[:, t],
                            "rid": same["rid"].to_numpy(),
                            "copies": same["copies"].to_numpy(),
                            "vector": [x.astype(kind).tobytes() for x in matrix],
                            "codes": [x.tobytes() for x in small[:, :t]],
                        }
                    )

    schema = "label string, dim int, at int, code long, rid long, copies long, vector binary, codes binary"
    rows = sized.select("rid", "label", "vector", "copies", "n_label").mapInPandas(coded, schema)
    cells = rows.select(F.xxhash64("label", "dim", "at", "code").alias("cell"), "at", "rid", "copies", "vector", "codes")
    n_rows = sum(r.rows * plan_tables(int(r.n), threshold, recall)[1] for r in _label_sizes(sizes))
    # Only buckets beyond a block are looked up; the others are one block.
    full = _text.written(cells.select("cell").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK))
    dealt = cells.join(full, "cell", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rid", F.lit(1)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = dealt.withColumn("other", other).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    groups = int(max(_text.shards_for(vectors), -(-n_rows // GROUP_ROWS)))
    part = F.pmod(F.xxhash64("cell", "i", "j"), F.lit(groups)).cast("int").alias("part")
    keyed = paired.select(part, "cell", "i", "j", "own", "at", "rid", "copies", "vector", "codes")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        dim = part["vector"].map(len) // np.dtype(kind).itemsize
        for (_, i, j, at, n), cell in part.groupby(["cell", "i", "j", "at", dim], sort=False):
            if len(cell) < 2:
                continue
            near = cosines(np.frombuffer(b"".join(cell["vector"]), dtype=kind).reshape(-1, n)) >= threshold
            np.fill_diagonal(near, False)
            if not near.any():
                continue
            own = cell["own"].to_numpy()
            if i != j:  # pairs inside a block have a group of their own
                near &= own[:, None] != own[None, :]
            if at:
                codes = np.frombuffer(b"".join(cell["codes"]), dtype=np.uint8).reshape(len(cell), at, -1)
                for t in range(at):
                    near &= (codes[:, None, t] != codes[None, :, t]).any(-1)
            a, b = np.nonzero(near)
            if not len(a):
                continue
            rid, copies = cell["rid"].to_numpy(), cell["copies"].to_numpy()
            low = local_components(len(cell), a, b)
            linked = np.flatnonzero(near.any(1))
            out.append(pd.DataFrame({"rid": rid[linked], "root": rid[low[linked]], "links": (near @ copies)[linked]}))
        return pd.concat(out) if out else pd.DataFrame({"rid": [], "root": [], "links": []}).astype("int64")

    links = _text.written(keyed.groupBy("part").applyInPandas(compare, "rid long, root long, links long"))
    closed = components(links.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("rid").agg(F.sum("links").alias("links"))
    whole = reps.select("rid", "least", "copies").join(closed.withColumnRenamed("node", "rid"), "rid", "left").join(counts, "rid", "left")
    whole = whole.withColumn("component", F.coalesce("component", "rid"))
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    whole = _text.written(whole.join(least, "component").select("rid", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    # Rows without a valid vector have no partner; they are dealt by hashes of their own, not to one task.
    plain = plain.withColumn("key", F.coalesce("rid", F.xxhash64("vec_id", F.monotonically_increasing_id())))
    component = F.when(F.col("rid").isNull(), F.col("vec_id")).otherwise(F.coalesce("component_id", "vec_id"))
    return plain.join(whole.withColumnRenamed("rid", "key"), "key", "left").select(
        "vec_id",
        F.when(F.col("rid").isNull(), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
