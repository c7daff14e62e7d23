"""Mixing sources to target weights with exact token budgets.

Style: DataFrame operations only.

Every document gets a hash-random key.  Within a source documents are range-sorted by (key, id,
size): the range of keys is cut into equal slices (uniform keys fill them evenly, however large
the source), slices are summed, and prefix sums over the slices tell in which slice the budget
ends.  Only that slice is sorted, in groups of equal documents, and a running sum finds the cut.
A source whose target is above its size repeats whole epochs; what is left of the target is cut
from the sorted order at the exact word, so the documents at the cut count in part.

So a mix is a row for each source, its *plan*: whole epochs and the place of the cut.  What a
document contributes follows from its own key and its source's plan; texts are never shuffled.

Targets: sources ordered by code point, null last, take the weights in turn and share
``percent`` of all sizes; a target stops at ``cap`` times its source's size, the excess going
to the others by weight until none is above.  That is min(cap * size, level * weight) with one
common level, found from the sources ordered by cap / weight.

*Scale.*  The thin table of sources, sizes and keys is staged, so reruns and lost executors see
the same.  Sums are pre-aggregated by (source, slice); a hot source is spread over its slices, a
hot document (a third of the rows with one id) is one group.  The targets are found in one task
of a row for each source; the plan, of the same size, joins the documents as the planner
chooses by its written size.

Defined cases: a null or empty text has size 0; a source of size 0 has target 0; a null source
is a source of its own; a null id hashes as its text's digest; rows that tie in key, id and size
at the cut share what is left in equal whole words; very long texts are counted whole; equal
rows get equal results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressline.llm.common import Workspace

WEIGHTS = (5, 2, 1)
PERCENT, CAP = 150, 2
KEY_BITS = 60
ROWS_A_SLICE, LEAST_SLICES = 50_000, 64


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ words; 0 for null."""
    gaps = F.regexp_replace(text, "[^\\x20\\x09-\\x0D]+", "w")
    return F.coalesce(F.length(F.regexp_replace(gaps, "[^w]", "")), F.lit(0)).cast("long")


def random_key(id_col: Column, text: Column, seed: int) -> Column:
    name = F.coalesce(id_col.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, percent: int = PERCENT, cap: int = CAP) -> DataFrame:
    """sizes (source, source_size), a row per source, with its target."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    w = sizes.withColumn("weight", weight).withColumn("bound", F.col("source_size") * cap)
    order = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    w = w.select("*", F.sum("bound").over(order).alias("b"), F.sum("weight").over(order).alias("wsum"), F.sum("source_size").over(whole).alias("all_size"), F.sum("weight").over(whole).alias("all_weight"))
    # level if the sources before this one are at their bounds: this one stays below its own exactly if its ratio is not smaller
    level = (F.col("all_size") * percent / 100 - (F.col("b") - F.col("bound"))) / (F.col("all_weight") - F.col("wsum") + F.col("weight"))
    w = w.withColumn("level", F.when(F.col("bound") / F.col("weight") >= level, level))
    w = w.withColumn("level", F.max("level").over(whole))  # it falls from the first source that qualifies on
    return w.select("source", "source_size", F.least(F.col("bound").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.col("bound").cast("double"))).alias("target"))


PLAN = ("source_size", "target", "epochs", "cut_key", "cut_id", "cut_size", "cut_words")


def plan(thin: DataFrame, *, weights=WEIGHTS, percent: int = PERCENT, cap: int = CAP, workspace: Workspace) -> DataFrame:
    """A row for each source s of thin (id, source, size, key): PLAN.

    Documents before (cut_key, cut_id, cut_size) are taken once more than epochs, those at it
    give cut_words words of the last epoch each, those after it nothing; all null: none is.
    """
    ws = workspace
    slices = LEAST_SLICES
    n_rows = thin.count()
    while slices * ROWS_A_SLICE < n_rows:
        slices *= 2
    sliced = thin.withColumn("slice", F.shiftright("key", KEY_BITS - (slices.bit_length() - 1)))
    sums = ws.stage(sliced.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")), "slices")
    goal = targets(sums.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, percent, cap)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    goal = ws.stage(goal.withColumnRenamed("source", "s"), "targets")
    ahead = F.sum("slice_size").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("slice_size")
    starts = sums.withColumn("ahead", ahead).join(goal, F.col("source").eqNullSafe(F.col("s")))
    ends = starts.filter((F.col("ahead") < F.col("rest")) & (F.col("rest") <= F.col("ahead") + F.col("slice_size")))  # one slice for each source with a cut
    ends = ws.stage(ends.select("s", F.col("slice").alias("sl"), "ahead", "rest"), "ends")
    inside = sliced.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("sl")))
    same = inside.groupBy("s", "ahead", "rest", "key", "id", "size").agg(F.count(F.lit(1)).alias("n"))
    run = F.col("ahead") + F.sum(F.col("size") * F.col("n")).over(Window.partitionBy("s").orderBy("key", F.col("id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.col("run") - F.col("size") * F.col("n")
    at = same.withColumn("run", run).filter((before < F.col("rest")) & (F.col("rest") <= F.col("run")))
    words = F.floor((F.col("rest") - before) / F.col("n")).cast("long")
    at = at.select(F.col("s").alias("s2"), F.col("key").alias("cut_key"), F.col("id").alias("cut_id"), F.col("size").alias("cut_size"), words.alias("cut_words"))
    return ws.stage(goal.join(at, F.col("s").eqNullSafe(F.col("s2")), "left").select("s", *PLAN), "plan")


def last_epoch(id_: Column, key: Column, size: Column) -> Column:
    """Words that the last, partial epoch takes of a document, by its source's plan; null before anything is known of the cut is 0."""
    first = lambda a, b, then: F.when(a < b, size).when(a > b, F.lit(0)).otherwise(then)
    by_size = first(size, F.col("cut_size"), F.col("cut_words"))
    # null ids are first, as in the sort
    by_id = F.when(id_.isNull() & F.col("cut_id").isNotNull(), size).when(id_.isNotNull() & F.col("cut_id").isNull(), F.lit(0)).when(id_.isNull(), by_size).otherwise(first(id_, F.col("cut_id"), by_size))
    return F.when(F.col("cut_key").isNull(), F.lit(0)).otherwise(first(key, F.col("cut_key"), by_id)).cast("long")


def _thin(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), random_key(F.col(id_col), F.col(text_col), seed).alias("key"))


def mix(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, weights=WEIGHTS, percent: int = PERCENT, cap: int = CAP, workspace: Workspace) -> DataFrame:
    """One row per row of df: id_col, size, source_size, target, epochs (whole repeats), cut (words of the last, partial epoch), taken."""
    thin = workspace.stage(_thin(df, id_col, text_col, source_col, seed), "keys")
    per = plan(thin, weights=weights, percent=percent, cap=cap, workspace=workspace)
    placed = thin.join(per, F.col("source").eqNullSafe(F.col("s"))).withColumn("cut", last_epoch(F.col("id"), F.col("key"), F.col("size")))
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", "epochs", "cut", (F.col("epochs") * F.col("size") + F.col("cut")).alias("taken"))


def repeat(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, weights=WEIGHTS, percent: int = PERCENT, cap: int = CAP, workspace: Workspace) -> DataFrame:
    """The rows of df as often as the mix takes them, whole: a document at the cut is in if at least half of it is.

    Each row is told by its own key and its source's plan, so texts stay where they are.
    """
    thin = workspace.stage(_thin(df, id_col, text_col, source_col, seed), "keys")
    per = plan(thin, weights=weights, percent=percent, cap=cap, workspace=workspace)
    size = word_count(F.col(text_col))
    told = per.select(F.col("s").alias("__source"), F.struct(*PLAN).alias("__plan"))
    joined = df.join(told, F.col(source_col).eqNullSafe(F.col("__source")))
    with_plan = joined.select("*", *(F.col("__plan")[c].alias(f"__{c}") for c in ("epochs", "cut_key", "cut_id", "cut_size", "cut_words")))
    key, id_ = random_key(F.col(id_col), F.col(text_col), seed), F.col(id_col)
    c = lambda name: F.col(f"__{name}")
    half = 2 * c("cut_words") >= c("cut_size")
    by_size = F.when(size < c("cut_size"), F.lit(True)).when(size > c("cut_size"), F.lit(False)).otherwise(half)
    by_id = F.when(id_.isNull() & c("cut_id").isNotNull(), F.lit(True)).when(id_.isNotNull() & c("cut_id").isNull(), F.lit(False)).when(id_.isNull() | (id_ == c("cut_id")), by_size).otherwise(id_ < c("cut_id"))
    last = F.when(c("cut_key").isNull(), F.lit(False)).when(key == c("cut_key"), by_id).otherwise(key < c("cut_key"))
    copies = (c("epochs") + last.cast("int")).cast("int")
    many = with_plan.withColumn("__copies", copies).filter("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return many.select(*df.columns)


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INTEGER)] AS weight, source_size * {CAP} AS bound FROM s),
c AS (SELECT *, sum(bound) OVER o AS b, sum(weight) OVER o AS wsum, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight
      FROM w WINDOW o AS (ORDER BY CAST(bound AS DOUBLE) / weight, source IS NULL, source ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, (CAST(all_size * {PERCENT} AS DOUBLE) / 100 - CAST(b - bound AS DOUBLE)) / CAST(all_weight - wsum + weight AS DOUBLE) AS level FROM c),
t AS (SELECT source, source_size, least(CAST(bound AS DOUBLE), coalesce(weight * (SELECT max(level) FROM l WHERE CAST(bound AS DOUBLE) / weight >= level), CAST(bound AS DOUBLE))) AS target FROM l),
g AS (SELECT source, k, doc_id, size, count(*) AS n FROM d GROUP BY ALL),
r AS (SELECT *, CAST(sum(size * n) OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size * n AS before FROM g),
p AS (SELECT r.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p),
w1 AS (SELECT *, CAST(epochs * size + greatest(0, least(size, (budget - epochs * source_size - before) // n)) AS BIGINT) AS taken FROM e)
SELECT d.doc_id, d.size, source_size, target, taken FROM d JOIN w1 ON d.source IS NOT DISTINCT FROM w1.source AND d.k = w1.k AND d.doc_id IS NOT DISTINCT FROM w1.doc_id AND d.size = w1.size
"""
