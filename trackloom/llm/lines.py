"""Line dedup by a log-template tree: a line's path is its number of tokens and its leading tokens, where
variable fields (tokens with a digit or an @) count as <*>. A leaf of that fixed depth has a list of templates,
found by splitting its distinct lines in rounds. A group's template has, at each further place, the token
that more than half of the group's lines have there, or <*>; lines that agree with it in `similarity`
percent of the further places belong to it. The group's other lines part at one place: the one where the tokens
that two lines or more and at most half of the group have give the largest sum of squared counts (of equal
ones the first). Those with the same token there form a group; those with the token of the template, or
with one that no other has, form the group <*>. Groups of one line and groups without such a place end;
their lines are templates of their own. A round at least halves a group or takes its repeated tokens at a
place away, so rounds grow with the logarithm of lines and with places, not with templates. Lines whose template recurs across documents are
dropped, but for those of the document with the smallest id, where the passage stays once. DataFrame functions only.

A template with k fixed tokens recurs if it is in two documents or more and documents times k are at least
min_weight: long lines from two documents on, shorter ones from more. Templates with fewer than
short_tokens fixed tokens recur by chance, so they must also be in short_share of all documents.

Lines are \\n-split; tokens are runs of [^\\x20\\x09-\\x0D]; lines without any stay. A null text stays null.
A document with a null id is never the one where a passage stays, unless all of the template's ids are
null; then no line is dropped. Rows that agree in id and text fare alike and count as one document. Lines
and tokens are told apart by 64-bit hashes.

Texts are shuffled once, to take the dropped lines out. Lines travel as hashes; hashes of tokens are only
moved for distinct lines of leaves that hold several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm import _text

#: A token with a variable field. The look-behind starts it at a token's start, and the possessive
#: quantifiers keep the search linear in long tokens.
VARIABLE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Bound on the broadcast list of leaf buckets, and on the broadcast groups that hold most lines.
LEAF_BUCKETS, LARGE_GROUPS = 1 << 20, 1_000


def masked_lines(text: Column) -> Column:
    """The lines with variable fields generalised, and one blank between tokens. Only lines that need it
    go through the regular expressions."""

    def general(line: Column) -> Column:
        return F.when(line.rlike("[0-9@]"), F.regexp_replace(line, VARIABLE, "<*>")).otherwise(line)

    def spaced(line: Column) -> Column:
        return F.trim(F.when(line.rlike(r"\x20\x20|[\x09\x0B-\x0D]"), F.regexp_replace(line, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(line))

    # One transform after another: a lambda's argument is evaluated once, an expression at each use.
    return F.transform(F.transform(F.split(text, "\n"), general), spaced)


def token_count(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def leaf_of(line: Column, depth: int) -> Column:
    return F.xxhash64(token_count(line), F.substring_index(line, " ", depth))


def line_places(documents: DataFrame, depth: int) -> DataFrame:
    """(doc_id, hash, at, key, leaf, n): each line of (doc_id, text) with tokens, its leaf and their number."""

    def place(line: Column) -> Column:
        return F.when(line != "", F.struct(F.xxhash64(line).alias("key"), leaf_of(line, depth).alias("leaf"), token_count(line).alias("n")))

    # explode_outer, as for explode Spark would compute the keys once more to drop empty arrays.
    places = F.posexplode_outer(F.transform(masked_lines(F.col("text")), place)).alias("at", "line")
    return documents.select("doc_id", F.xxhash64("text").alias("hash"), places).where("line is not null").select("doc_id", "hash", "at", "line.*")


def shared_leaves(places: DataFrame, depth: int, similarity: int) -> DataFrame:
    """(leaf, n_lines): leaves with several distinct lines, long enough that one may differ in a token."""
    free = (F.col("n") - depth) * (100 - similarity) >= 100
    return places.where(free).select("leaf", "key").distinct().groupBy("leaf").agg(F.count("*").alias("n_lines")).where("n_lines > 1")


def leaf_lines(documents: DataFrame, leaves: DataFrame, depth: int) -> DataFrame:
    """(group, key, tokens): the distinct lines of the leaves, with hashes of the tokens after the leading ones."""
    bucket = F.pmod("leaf", F.lit(LEAF_BUCKETS)).alias("bucket")
    some = F.broadcast(leaves.select(bucket).distinct())  # at most LEAF_BUCKETS rows

    def place(line: Column) -> Column:
        return F.when(line != "", F.struct(F.xxhash64(line).alias("key"), leaf_of(line, depth).alias("leaf"), line.alias("line")))

    lines = documents.select(F.explode_outer(F.transform(masked_lines(F.col("text")), place)).alias("x")).where("x is not null").select("x.*")
    held = lines.withColumn("bucket", bucket).join(some, "bucket", "left_semi").dropDuplicates(["key"]).join(leaves, "leaf")
    tokens = F.transform(F.slice(F.split("line", " "), F.lit(depth + 1), F.size(F.split("line", " "))), lambda x: F.xxhash64(x))
    return held.select(F.col("leaf").alias("group"), "key", tokens.alias("tokens"))


def group_facts(lines: DataFrame) -> DataFrame:
    """(group, m, fixed, score, at): each group of several lines, its size, the fixed (at, token) of its
    template, and the place where other lines part, which has a score of 0 where none do."""
    pairs = lines.select("group", F.posexplode("tokens").alias("at", "token")).groupBy("group", "at", "token").agg(F.count("*").alias("n"))
    squares = F.sum(F.when(F.col("n") >= 2, F.col("n") * F.col("n")).otherwise(0))
    places = pairs.groupBy("group", "at").agg(F.sum("n").alias("m"), F.max(F.struct("n", "token")).alias("top"), squares.alias("squares"))
    major = 2 * F.col("top.n") > F.col("m")
    score = F.col("squares") - F.when(major, F.col("top.n") * F.col("top.n")).otherwise(0)
    fixed = F.collect_list(F.when(major, F.struct("at", F.col("top.token").alias("token"))))
    best = F.max(F.struct(score.alias("score"), (-F.col("at")).alias("back")))
    facts = places.where("m > 1").groupBy("group").agg(F.max("m").alias("m"), fixed.alias("fixed"), best.alias("best"))
    return facts.select("group", "m", "fixed", "best.score", (-F.col("best.back")).alias("at"))


def parted(lines: DataFrame, facts: DataFrame, n_lines: int, depth: int, similarity: int) -> DataFrame:
    """(group, key, tokens, template, fixed, child): lines of groups of several; those of the group's template have
    template and fixed, others child, the group that they go to, or none of these where the group ends."""
    large = F.col("m") * LARGE_GROUPS >= n_lines
    hot = F.broadcast(facts.where(large))  # at most LARGE_GROUPS rows; no other group has more than their share of lines
    rest = lines.join(F.broadcast(facts.where(large).select("group")), "group", "left_anti").join(facts.where(~large), "group")
    met = lines.join(hot, "group").select(*rest.columns).unionByName(rest)
    agree = F.size(F.filter("fixed", lambda x: F.get("tokens", x["at"]) == x["token"]))
    token = F.get("tokens", F.col("at"))
    usual = F.exists("fixed", lambda x: (x["at"] == F.col("at")) & (x["token"] == token))
    own = 100 * agree >= similarity * F.size("tokens")
    child = F.when(usual, variable_group()).otherwise(F.xxhash64("group", "at", token))
    return met.select(
        "group",
        "key",
        "tokens",
        F.when(own, F.xxhash64("group", F.lit("template"))).alias("template"),
        F.when(own, F.size("fixed") + depth).alias("fixed"),
        F.when(~own & (F.col("score") > 0), child).alias("child"),
    )


def variable_group() -> Column:
    """The group of a group's lines whose token where they part is variable."""
    return F.xxhash64("group", F.lit("<*>"))


def generalised(lines: DataFrame, depth: int, similarity: int) -> DataFrame:
    """(key, template, fixed): the lines that belong to a template of their leaf, and its number of fixed
    tokens. Each round is a written table; the number of lines left is all that comes to the driver."""
    found = lines.select("key", F.col("key").alias("template"), F.lit(0).alias("fixed")).limit(0)
    while True:
        facts = _text.written(group_facts(lines))
        n_lines = facts.agg(F.sum("m")).first()[0]
        if not n_lines:
            return found
        step = _text.written(parted(lines, facts, n_lines, depth, similarity))
        found = found.unionByName(step.where("template is not null").select("key", "template", "fixed"))
        rest = step.where("child is not null")
        # A key is one line, so this join has no hot key.
        alone = rest.groupBy("child").agg(F.count("*").alias("n"), F.min("key").alias("key")).where("n = 1").select("key", F.lit(True).alias("alone"))
        group = F.when(F.col("alone"), variable_group()).otherwise(F.col("child"))
        lines = _text.written(rest.join(alone, "key", "left").select(group.alias("group"), "key", "tokens"))


def recurring_templates(placed: DataFrame, n_documents: int, min_weight: int, short_tokens: int, short_share: float) -> DataFrame:
    """(template, keeper): templates that recur, and where they stay."""
    n = F.col("n_docs")
    often = (n >= 2) & (n * F.col("fixed") >= min_weight) & ((F.col("fixed") >= short_tokens) | (n >= short_share * n_documents))
    return (
        placed.select("template", "fixed", "doc_id", "hash")
        .distinct()
        .groupBy("template", "fixed")
        .agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("keeper"))
        .where(often & F.col("keeper").isNotNull())
        .select("template", "keeper")
    )


def drop_recurring_lines(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = 3,
    similarity: int = 75,
    min_weight: int = 20,
    short_tokens: int = 5,
    short_share: float = 0.005,
) -> DataFrame:
    """The documents with the text that remains and two more columns, n_lines and n_dropped (these
    replace columns of the same name). See the module for the rule and for edge cases."""
    texts = _text.texts_of(documents, id_col, text_col)
    places = _text.written(line_places(texts, depth))
    leaves = _text.written(shared_leaves(places, depth, similarity))
    lines = _text.written(leaf_lines(texts, leaves, depth))
    general = _text.written(generalised(lines, depth, similarity))
    placed = places.join(general, "key", "left").select(
        "doc_id", "hash", "at", F.coalesce("template", "key").alias("template"), F.coalesce("fixed", "n").alias("fixed")
    )
    recurring = _text.written(recurring_templates(placed, texts.count(), min_weight, short_tokens, short_share))
    drops = (
        placed.join(recurring, "template")
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"))
        .agg(F.collect_set("at").alias("__drop"))
    )
    held = documents.withColumn("__text_hash", F.xxhash64(F.col(text_col)))
    same = held[id_col].eqNullSafe(drops["__id"]) & (held["__text_hash"] == drops["__hash"])
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop")), lambda at: F.get("__lines", at))
    out = held.join(drops, same, "left").withColumn("__lines", F.split(F.col(text_col), "\n"))
    return (
        out.withColumn("n_dropped", F.when(F.col("__drop").isNull(), F.lit(0)).otherwise(F.size("__drop")).cast("long"))
        .withColumn("n_lines", F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size("__lines")).cast("long"))
        .withColumn(text_col, F.when(F.col("__drop").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")))
        .select(*[c for c in documents.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
    )
