"""Secret scans over an incremental blob ledger: every version of a text is content-addressed, only
pairs of blob and rule version that the ledger doesn't hold are scanned, their findings are appended
to the ledger, and findings are joined back from it to all documents with that content. DataFrame
functions only.

The ledger is a Parquet table (blob, hash, rules, spans), one row for each scan of a blob: the rule
versions scanned, comma-joined, and all findings. A scan's row is appended in one write, so a lost job
leaves no pair marked without its findings. Given a path, the ledger stays there and later runs scan
only what is new; without one, a run has a ledger of its own in the shared folder.

A null text counts as empty and has no findings; documents with equal texts share one scan. Texts that
very many rows have are dealt to several tasks when findings are joined back. Repeated and null ids
give one row for each input row. Positions are code points, ends exclusive."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.llm import _text
from trackloom.tables import scratch_dir

LEDGER = "blob string, hash long, rules string, spans array<struct<rule:string,start:bigint,end:bigint>>"
#: Rows with one text that a task of the join gets, at least; a text counts as hot from the larger of this
#: and a MAX_HOT-th of the rows on, so that the broadcast list of hot texts has at most MAX_HOT rows.
HOT_ROWS, MAX_HOT = 1_000, 20_000


@dataclass(frozen=True)
class Rule:
    """A pattern; its matches, leftmost first and not overlapping, count from min_chars in group `value`."""

    kind: str
    version: int
    pattern: str
    value: int
    min_chars: int

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base kinds, in the order that breaks ties.
BASE = [
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
]

#: Further public token formats.
MORE = [
    Rule("private_key", 2, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36}", 0, 40),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 30),
]

RULES = [*BASE, *MORE]


def blobs_of(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """(blob, text): each distinct content once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return documents.select(F.sha2(text, 256).alias("blob"), text.alias("text")).dropDuplicates(["blob"])


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at a path, None where there isn't one yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def unseen(blobs: DataFrame, ledger: DataFrame | None, rules: list[Rule]) -> DataFrame:
    """(blob, text, todo): the rule keys that the ledger doesn't hold for the blob."""
    keys = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        return blobs.withColumn("todo", keys)
    seen = ledger.groupBy("blob").agg(F.flatten(F.collect_list(F.split("rules", ","))).alias("seen"))
    todo = F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", "text", todo.alias("todo")).where(F.size("todo") > 0)


def _by_rule(rules: list[Rule], make) -> Column:
    out = None
    for rule in rules:
        test = F.col("rule") == rule.key
        out = F.when(test, make(rule)) if out is None else out.when(test, make(rule))
    return out


def scan(todo: DataFrame, rules: list[Rule]) -> DataFrame:
    """The ledger's rows for (blob, text, todo). A text's gaps between the matches and the matches
    themselves add up to the matches' places."""
    hits = [F.when(F.array_contains("todo", r.key) & F.col("text").rlike(r.pattern), F.lit(r.key)) for r in rules]
    found = todo.select(
        "blob", F.xxhash64("text").alias("hash"), F.array_join("todo", ",").alias("rules"), "text", F.explode_outer(F.array_compact(F.array(*hits))).alias("rule")
    )
    length = lambda x: F.length(x)
    parts = found.select(
        "blob", "hash", "rules", "rule",
        F.posexplode_outer(
            F.arrays_zip(
                F.transform(_by_rule(rules, lambda r: F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))), length).alias("size"),
                F.transform(_by_rule(rules, lambda r: F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.value))), length).alias("chars"),
                F.transform(_by_rule(rules, lambda r: F.split("text", r.pattern, -1)), length).alias("gap"),
            )
        ).alias("at", "m"),
    ).select("blob", "hash", "rules", "rule", "at", "m.*")
    upto = Window.partitionBy("blob", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(upto)
    counts = F.col("size").isNotNull() & (F.col("chars") >= _by_rule(rules, lambda r: F.lit(r.min_chars)))
    span = F.when(counts, F.struct("rule", (F.col("end") - F.col("size")).cast("long").alias("start"), F.col("end").cast("long").alias("end")))
    return parts.withColumn("end", end).groupBy("blob", "hash", "rules").agg(F.collect_list(span).alias("spans"))


def update_ledger(documents: DataFrame, path: str, rules: list[Rule] | None = None, text_col: str = "text", known: bool = True) -> DataFrame:
    """Scans what the ledger at the path doesn't hold, appends it, and returns the ledger. `known` says
    whether there may be a ledger already."""
    rules, spark = rules or RULES, documents.sparkSession
    todo = unseen(blobs_of(documents, text_col), read_ledger(spark, path) if known else None, rules)
    scan(todo, rules).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def findings(documents: DataFrame, rules: list[Rule], text_col: str, ledger: str | None) -> DataFrame:
    """(blob, hash, start, ord, kind, end): findings of the rules in all contents of the ledger, after the
    documents were added to it."""
    held = update_ledger(documents, ledger or scratch_dir(documents.sparkSession), rules, text_col, ledger is not None)
    spans = held.where(F.size("spans") > 0).select("blob", "hash", F.explode("spans").alias("s")).where(F.col("s.rule").isin([r.key for r in rules]))
    spans = spans.select("blob", "hash", "s.*").distinct()  # a scan that was repeated counts once
    place, kind = (_by_rule(rules, make) for make in (lambda r: F.lit(rules.index(r)), lambda r: F.lit(r.kind)))
    return spans.select("blob", "hash", "start", place.alias("ord"), kind.alias("kind"), "end")


def to_paths(documents: DataFrame, by_blob: DataFrame, text_col: str) -> DataFrame:
    """The documents with __blob and the columns of by_blob (blob, hash, ...); null for other contents.
    Rows of hot texts are dealt to several tasks, and what they are joined with is repeated for each."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = documents.count()
    hot_rows = max(HOT_ROWS, n // MAX_HOT)
    sizes = documents.groupBy(F.xxhash64(text).alias("__hash")).agg(F.count("*").alias("n")).where(F.col("n") > hot_rows)
    hot = _text.written(sizes.select("__hash", F.ceil(F.col("n") / hot_rows).cast("int").alias("__deals")))  # at most MAX_HOT rows
    deals = F.coalesce("__deals", F.lit(1))
    held = documents.withColumns({"__hash": F.xxhash64(text), "__blob": F.sha2(text, 256)}).join(F.broadcast(hot), "__hash", "left")
    held = held.withColumn("__deal", F.pmod(F.monotonically_increasing_id(), deals).cast("int")).drop("__hash", "__deals")
    spread = by_blob.withColumnsRenamed({"blob": "__blob", "hash": "__hash"}).join(F.broadcast(hot), "__hash", "left")
    spread = spread.withColumn("__deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("__hash", "__deals")
    return held.join(spread, ["__blob", "__deal"], "left").drop("__deal")


def find_secrets(documents: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", ledger: str | None = None) -> DataFrame:
    """(doc_id, blob, spans) of every document; spans, by start and then rule, is an empty array where
    nothing was found. `ledger` is the path of a ledger that is kept."""
    texts = _text.texts_of(documents, id_col, text_col)
    found = findings(texts, rules or RULES, "text", ledger)
    by_blob = found.groupBy("blob", "hash").agg(F.array_sort(F.collect_list(F.struct("start", "ord", "kind", "end"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,ord:int,kind:string,end:bigint>>")
    return to_paths(texts, by_blob, "text").select("doc_id", F.col("__blob").alias("blob"), F.coalesce("spans", none).alias("spans"))


def redact_secrets(documents: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", ledger: str | None = None) -> DataFrame:
    """The documents with every finding replaced by [kind]; other columns stay. Overlapping findings
    are merged into the one that starts first. A null text stays null."""
    found = findings(documents.select(F.col(text_col).alias("text")), rules or RULES, "text", ledger)
    by_start = Window.partitionBy("blob").orderBy("start", "end", "kind")
    before = by_start.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True)).cast("int")
    merged = (
        found.withColumn("g", F.sum(fresh).over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("blob", "hash", "g")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "end", "kind")).alias("kind"))
    )
    prior = F.coalesce(F.lag("end").over(Window.partitionBy("blob").orderBy("start")), F.lit(0))
    cuts = merged.select("blob", "hash", F.struct("start", "end", "kind", prior.alias("prior")).alias("cut"))
    cuts = cuts.groupBy("blob", "hash").agg(F.array_sort(F.collect_list("cut")).alias("__cuts"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = F.transform(
        "__cuts",
        lambda c: F.concat(F.substring(text, (c["prior"] + 1).cast("int"), (c["start"] - c["prior"]).cast("int")), F.lit("["), c["kind"], F.lit("]")),
    )
    rest = F.substring(text, (F.element_at("__cuts", -1)["end"] + 1).cast("int"), F.lit(2**31 - 1))
    redacted = F.when(F.col("__cuts").isNull(), F.col(text_col)).otherwise(F.concat(F.array_join(kept, ""), rest))
    return to_paths(documents, cuts, text_col).withColumn(text_col, redacted).select(*documents.columns)
