"""Merkle manifest of a dataset: rows are leaves, each group of rows a tree of its own, and the subroots of all
groups the leaves of one more tree. Every level equijoins nodes with the sibling indices that their run's
slot-zero node computes (index + 1, index + 2, ... for a run of `arity`), and slot-zero rows emit the parents.
Proofs go down again: a parent knows its children, so a child's siblings come with its parent's proof.

A leaf is the lowercase hex sha256 of its fields, each `-` if null, else its UTF-8 byte count, a colon and the
value. A parent is the sha256 of its children's digests as text; a last run may be short, even one node, and
is hashed all the same. A group of one row has the leaf itself as subroot, and one group its subroot as root.

Defined results: rows with a null group are a group, which comes first; a null id comes first in its group;
rows that agree in group and id are ordered by leaf (rows equal in all fields are interchangeable). An empty
table has no nodes, so there are no rows. Only the named columns are read, so other columns can't clash.

Nothing is held per group: ranges of (group, id) give positions, so a group of any share of the rows is dealt
to many tasks. Texts are hashed where they are read; only digests are shuffled."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm import _text

ARITY = 8
#: One element of a proof: the digests before and after the node in its run, each joined.
STEP = "array<struct<left:string,right:string>>"


def field_text(column: Column) -> Column:
    """A field of a leaf as it is hashed."""
    value = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field_text(c) for c in columns]), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with `at`, the place from 0 in their tree by `order`, and `n`, the tree's number of rows."""
    keys = ["tree", *order]
    ranged = rows.repartitionByRange(_text.shards_for(rows), *keys).sortWithinPartitions(*keys)
    ranged = _text.written(ranged.withColumn("part", F.spark_partition_id()).withColumn("number", F.monotonically_increasing_id()))
    starts = ranged.groupBy("tree", "part").agg(F.min("number").alias("first"), F.count("*").alias("held"))  # a row for each part and each tree in it
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(
        "tree", "part", (F.coalesce(F.sum("held").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("held").over(Window.partitionBy("tree")).alias("n")
    )
    return ranged.join(starts, ["tree", "part"]).withColumn("at", F.col("number") + F.col("shift")).drop("part", "number", "shift")


def parents_of(nodes: DataFrame, arity: int) -> DataFrame:
    """(tree, at, n, digest, children): the parents of the nodes (tree, at, n, digest) of trees that have several.
    Slot-zero rows ask for the indices of their run and are answered by an equijoin with the nodes."""
    several = nodes.where("n > 1").select("tree", "at", "n", "digest")
    zero = several.where(F.col("at") % arity == 0).select("tree", "n", "at", F.explode(F.sequence(F.lit(0), F.lit(arity - 1))).alias("slot"))
    asked = zero.select("tree", "n", F.expr(f"at div {arity}").alias("run"), "slot", (F.col("at") + F.col("slot")).alias("sibling")).where("sibling < n")
    found = asked.join(several.select("tree", F.col("at").alias("sibling"), "digest"), ["tree", "sibling"])
    runs = found.groupBy("tree", "run", "n").agg(F.sort_array(F.collect_list(F.struct("slot", "digest"))).alias("slots"))
    runs = runs.withColumn("children", F.col("slots.digest"))
    return runs.select(
        "tree", F.col("run").alias("at"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"), F.sha2(F.array_join("children", ""), 256).alias("digest"), "children"
    )


def climb(leaves: DataFrame, arity: int) -> list[DataFrame]:
    """The levels of all trees, from the leaves (tree, at, n, digest, ...) on; each is a written table. A tree is in
    the levels up to the one where it has one node."""
    levels, largest = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while largest > 1:
        levels.append(_text.written(parents_of(levels[-1], arity)))
        largest = -(-largest // arity)
    return levels


def descend(levels: list[DataFrame], above: DataFrame, arity: int) -> DataFrame:
    """The leaves with the columns of `above` (tree, path, ...), where `path` is extended from the tree's root down to
    the leaf. The last level isn't written."""
    more = [c for c in above.columns if c != "tree"]
    up = None
    for k, level in reversed(list(enumerate(levels))):
        found = level.where("n = 1").join(above, "tree")
        if up is not None:
            run = up.select("tree", F.col("at").alias("run"), F.col("children").alias("siblings"), *more)
            inner = level.where("n > 1").withColumn("run", F.expr(f"at div {arity}")).join(run, ["tree", "run"])
            slot = (F.col("at") % arity).cast("int")
            step = F.struct(
                F.array_join(F.slice("siblings", F.lit(1), slot), "").alias("left"), F.array_join(F.slice("siblings", slot + 2, F.lit(arity)), "").alias("right")
            )
            found = found.unionByName(inner.withColumn("path", F.concat(F.array(step), "path")).drop("run", "siblings"))
        up = _text.written(found) if k else found
    return up


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(path, leaf, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    """The sha256 of the siblings of all levels, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def merkle_manifest(
    documents: DataFrame,
    fields: list[str],
    id_col: str = "doc_id",
    group_col: str = "lang",
    claims: dict[str, Column] | None = None,
    arity: int = ARITY,
) -> DataFrame:
    """(doc_id, leaf, subroot, root, path) of each row, and the claims: more leaf digests of the row by name, to be
    checked against the proof with folded(). See the module for the rules and edge cases."""
    claims = claims or {}
    # A null group sorts before all others, as '-' sorts before '='.
    tree = F.when(F.col(group_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))
    rows = documents.select(tree.alias("tree"), F.col(id_col).alias("doc_id"), leaf_digest([F.col(c) for c in fields]).alias("digest"), *[c.alias(k) for k, c in claims.items()])
    levels = climb(_text.written(positions(rows, ["doc_id", "digest"])), arity)
    subroots = None
    for level in levels:
        done = level.where("n = 1").select("tree", "digest")
        subroots = done if subroots is None else subroots.unionByName(done)
    top = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest")
    tops = climb(_text.written(positions(top, ["group"])), arity)
    root = tops[-1].select("tree", F.lit(None).cast(STEP).alias("path"), F.col("digest").alias("root")).withColumn("path", F.array().cast(STEP))
    above = descend(tops, root, arity).select(F.col("group").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    out = descend(levels, _text.written(above), arity)
    return out.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", *claims)
