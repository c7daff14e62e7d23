"""Quality rules with risk-controlled thresholds.

Style: free for the measures of a text (Arrow batches, numpy); everything else is DataFrame
aggregation.  The measures of a text need that text only, so there is no shuffle of texts.

Base rules reject texts that are too short or repeat themselves.  Above them, a junk score
(the largest of several measures, each divided by its reference value) is cut per stratum at a
threshold that labelled holdouts justify: going from the mildest cutoff of a fixed grid to
stricter ones, a cutoff is taken while the exact binomial tail rejects, at the level delta /
strata, that more than ``alpha`` of the good documents of the stratum would be lost.  Fixed
sequences need no correction along the grid, and Bonferroni's correction joins the strata, so
with probability 1 - delta no certified cutoff of any stratum loses more than alpha of its good
documents.  As that holds for all of them at once, the one used may be picked by the labels:
the one with the least cost, a lost good document counting GOOD_COST times a kept bad one
(ties: the mildest).  A stratum with too few labelled good documents can't justify any cutoff
and rejects by the base rules alone.

The bound is for independent trials, so a holdout has one vote for each distinct text of a
stratum, however many copies or labels it has (good if any label says so: a lost good text is
the error that is bounded).  It is a bound on what the cutoff loses of the good texts that pass
the base rules; those that the base rules reject come on top and are no matter of labels
(``holdout`` counts both).

What reaches the driver is one histogram over the grid for each stratum that could be
certified at all (at least log(level)/log(1-alpha) good documents).

Defined cases: a null text counts as empty, and an empty one has no words and fails the base
rules; very long texts are measured whole; a null stratum is a stratum of its own; labels
without a document and null labels are ignored; ties with the cutoff are kept; repeated rows
each give their row and null ids stay, unlabelled; an empty table gives an empty result.
``keep`` returns all columns of its table unchanged, whatever their names; ``rules`` reads no
others than it names, and raises where the id or stratum is named like one of its results.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressline.llm.common import Sieve, WordHash, ship, window_hashes

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
ALPHA, DELTA, GOOD_COST = 0.02, 0.05, 10
#: Cutoffs on the junk score, mildest first.
GRID = tuple(round(8.0 * 0.9**i, 6) for i in range(40))
#: The reference value of each measure: a text at its value has a junk score of 1.
REFERENCE = {"symbols_per_word": 0.1, "upper_share": 0.3, "dup_line_share": 0.3, "repeat_share": 0.3, "long_words": 12.0}

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_SPACES = re.compile("[\x20\x09-\x0d]+")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words")


def repeated_words(hashes: np.ndarray) -> int:
    """Words that lie in a three-word window which occurs at least twice."""
    if len(hashes) < 4:
        return 0
    windows = window_hashes(hashes, 3)
    _, where, counts = np.unique(windows, return_inverse=True, return_counts=True)
    many = counts[where] >= 2
    if not many.any():
        return 0
    covered = np.zeros(len(hashes), bool)
    for i in range(3):
        covered[i : i + len(many)] |= many
    return int(covered.sum())


def measure(text: str, table: WordHash) -> tuple[int, ...]:
    """The measures of one text, in the order of MEASURES."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return (0, 0, len(_SYMBOLS.findall(text)), 0, 0, 0, 0)
    word_chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    seen: set[bytes] = set()
    lines = dups = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dups += 1
            else:
                seen.add(line)
    upper = sum(1 for w in words if w.isupper() and len(w) > 1)
    return len(words), word_chars, len(_SYMBOLS.findall(text)), dups, repeated_words(table.array(words)), lines, upper


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name = "_" + name
    return name


def measures(df: DataFrame, id_col: str, text_col: str, *keep: str, into: str) -> DataFrame:
    """id_col, the columns in keep (the text may be one) and ``into``: a struct of the MEASURES of each text and two halves of its digest."""
    ship(df.sparkSession)
    kept = [id_col, *keep]
    at = kept.index(text_col) if text_col in kept else len(kept)
    names = [*MEASURES, "digest1", "digest2"]
    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept] + [f"`{into}` struct<{', '.join(f'{m}:bigint' for m in names)}>"]

    def batches(it):
        table = WordHash()
        for batch in it:
            rows = []
            for raw in batch.column(at).cast(pa.binary()):
                raw = raw.as_py() or b""
                digest = xxhash.xxh3_128_digest(raw)
                rows.append((*measure(raw.decode("utf-8", "replace"), table), int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            found = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], found], names=[*kept, into])

    return df.select(*kept, *([] if text_col in kept else [text_col])).mapInArrow(batches, ", ".join(fields))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def junk_score(m: Column) -> Column:
    """The largest of the measures over their reference values; 0 for a text without words."""
    words = F.greatest(m["n_words"], F.lit(1)).cast("double")
    lines = F.greatest(m["n_lines"], F.lit(1)).cast("double")
    parts = {
        "symbols_per_word": m["n_symbols"] / words,
        "upper_share": m["n_upper_words"] / words,
        "dup_line_share": m["n_dup_lines"] / lines,
        "repeat_share": m["n_repeat_words"] / words,
        "long_words": m["word_chars"] / words,
    }
    return F.greatest(*(parts[k] / F.lit(v) for k, v in REFERENCE.items()))


def binomial_tail(x: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= x), summed exactly in logarithms."""
    if x >= n:
        return 1.0
    i = np.arange(x + 1)
    choose = math.lgamma(n + 1) - np.array([math.lgamma(k + 1) + math.lgamma(n - k + 1) for k in i])
    logs = choose + i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def certify(lost: list[int], caught: list[int], n: int, alpha: float, level: float, grid=GRID) -> float | None:
    """The cheapest certified cutoff of the fixed sequence; None if no cutoff is certified or worth its cost.

    lost, caught: good and bad documents with a score above each cutoff of the grid.
    """
    best, least = None, 0
    for cutoff, x, y in zip(grid, lost, caught, strict=True):
        if binomial_tail(x, n, alpha) > level:
            break
        if GOOD_COST * x - y < least:
            best, least = cutoff, GOOD_COST * x - y
    return best


def votes(measured: DataFrame, labels: DataFrame, id_col: str, label_col: str, stratum: str, m: str) -> DataFrame:
    """A row for each distinct labelled text of a stratum: stratum, good, failed (by the base rules), score."""
    marks = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), (F.col(label_col) == 1).alias("good"))
    found = measured.select(F.col(id_col).alias("id"), F.col(stratum).alias("stratum"), F.col(m).alias("m"))
    # measures depend on the text alone, so all rows of a digest have the same
    same = found.join(marks, "id").groupBy("stratum", F.col("m.digest1"), F.col("m.digest2")).agg(F.max("good").alias("good"), F.first("m").alias("m"))
    return same.select("stratum", "good", base_failed(F.col("m")).alias("failed"), junk_score(F.col("m")).alias("score"))


def cutoffs(votes: DataFrame, *, alpha: float = ALPHA, delta: float = DELTA) -> dict:
    """stratum value -> certified cutoff, from the votes that pass the base rules."""
    above = lambda c, good: F.count(F.when((F.col("score") > c) & (F.col("good") == good), 1))
    per = (
        votes.filter("NOT failed")
        .groupBy("stratum")
        .agg(F.count_if("good").alias("n"), *(above(c, True).alias(f"x{i}") for i, c in enumerate(GRID)), *(above(c, False).alias(f"y{i}") for i, c in enumerate(GRID)))
        .filter(F.col("n") >= math.log(delta) / math.log1p(-alpha))
    )
    rows = per.collect()
    level = delta / max(1, len(rows))
    out = {}
    for r in rows:
        cut = certify([r[f"x{i}"] for i in range(len(GRID))], [r[f"y{i}"] for i in range(len(GRID))], r["n"], alpha, level)
        if cut is not None:
            out[r["stratum"]] = cut
    return out


def cutoff_of(cuts: dict, stratum: Column) -> Column:
    cut = F.lit(None).cast("double")
    for value, c in cuts.items():
        cut = F.when(stratum.eqNullSafe(F.lit(value)), F.lit(c)).otherwise(cut)
    return cut


def verdict(m: Column, stratum: Column, cuts: dict) -> Column:
    """Do the rules keep a text with the measures m?"""
    return ~base_failed(m) & ~F.coalesce(junk_score(m) > cutoff_of(cuts, stratum), F.lit(False))


def holdout(votes: DataFrame, cuts: dict) -> DataFrame:
    """What the labelled texts of each stratum show: good and bad ones, how many of them the base rules reject, and how many more the cutoff."""
    cut = F.coalesce(~F.col("failed") & (F.col("score") > cutoff_of(cuts, F.col("stratum"))), F.lit(False))
    count = lambda good, what: F.count_if((F.col("good") == good) & what)
    parts = {"": F.lit(True), "_base": F.col("failed"), "_cut": cut}
    return votes.groupBy("stratum").agg(*(count(good, what).alias(name + tail) for name, good in (("good", True), ("bad", False)) for tail, what in parts.items()))


def keep(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", stratum: str = "lang", workspace) -> DataFrame:
    """The rows of df that the rules keep, with df's columns.

    Texts that may be labelled, by a bounded sieve of hashed ids, are measured for the cutoffs;
    then all are measured and judged in one pass.  Texts are neither shuffled nor staged.
    """
    m = fresh(df, "__measures")
    ids = workspace.stage(labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(id_col).distinct(), "labelled")
    likely = Sieve(workspace, ids, "sieve").mark(df.select(*dict.fromkeys((id_col, stratum, text_col))), id_col).filter("__held")
    measured = workspace.stage(measures(likely, id_col, text_col, stratum, into=m), "measures")
    cuts = cutoffs(votes(measured, labels, id_col, label_col, stratum, m))
    others = [c for c in df.columns if c != id_col]
    return measures(df, id_col, text_col, *others, into=m).filter(verdict(F.col(m), F.col(stratum), cuts)).select(*df.columns)


def rules(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", stratum: str = "lang", workspace, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per row of df: id, stratum, MEASURES, base_failed, junk_score, kept.

    The measures are staged in the workspace: the holdout and the verdicts read them, the
    texts are read once.
    """
    out = [*MEASURES, "base_failed", "junk_score", "kept"]
    if {id_col, stratum} & set(out):
        raise ValueError(f"the id and the stratum can't be named like a result: {out}")
    m = fresh(df, "__measures")
    measured = workspace.stage(measures(df, id_col, text_col, stratum, into=m), "measures")
    cuts = cutoffs(votes(measured, labels, id_col, label_col, stratum, m), alpha=alpha, delta=delta)
    found = F.col(m)
    return measured.select(id_col, stratum, *(found[x].alias(x) for x in MEASURES), base_failed(found).alias("base_failed"), junk_score(found).alias("junk_score"), verdict(found, F.col(stratum), cuts).alias("kept"))
