"""Corpus pipeline: documents in, token statistics of the mixed corpus out.

Five stages, each an operator of ``pressline.llm`` whose decisions take effect: rejected
documents go, one document of each group of near copies stays, secrets are masked, sources are
mixed (documents repeat or drop out), and what is left is encoded.  All but the last return the
columns of documents; every stage's result is written as Parquet before the next one reads it.

Texts stay where they are but for those that are, or by a bounded sieve of hashed ids may be,
near copies: these join decisions by id in shuffles at every size, as a broadcast of ids would
grow with the corpus.

Defined cases, for each stage those of its operator and: null and empty texts have no words, so
the quality rules reject them; very long texts pass whole; rows that repeat an id are one
document from near_dedup on; ties and equal rows get equal decisions; rows without an id stay
apart; columns beyond those of documents are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pressline.llm import bpe, minhash, mixing, quality, secret_scan
from pressline.llm.common import Sieve, Workspace

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df):
    return df.select(*COLUMNS)


def quality_rules(spark, docs, sf_dir):
    """Documents that the rules keep, in whole; labels are those of the input folder."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(_documents(docs), labels, workspace=Workspace(spark, "pipeline-quality"))


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies: the one with the smallest id.

    Rows that repeat an id are one document and leave one row (the smallest); rows without an
    id can't be told apart by it and all stay.  Only rows that a sieve holds for copies are
    shuffled.
    """
    ws = Workspace(spark, "pipeline-dedup")
    marked = minhash.near_duplicates(docs, shingle=minhash.SHINGLE, percent=80, workspace=ws)
    per = marked.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.max("kept").alias("__kept"), F.count(F.lit(1)).alias("n"))
    copies = ws.stage(per.filter("NOT __kept OR n > 1").select("__id", "__kept"), "copies")
    held = Sieve(ws, copies.select("__id"), "copies-sieve").mark(_documents(docs), "doc_id")
    told = held.filter("__held").hint("merge").join(copies, F.col("doc_id") == F.col("__id"), "left")
    first = F.min(F.struct(*COLUMNS[1:])).alias("row")
    again = told.filter("__kept").groupBy("doc_id").agg(first).select("doc_id", "row.*")
    return _documents(held.filter("NOT __held")).unionByName(_documents(told.filter("__id IS NULL"))).unionByName(_documents(again))


def secret_scans(spark, docs, sf_dir):
    """All documents, with the spans of secrets masked."""
    return secret_scan.mask(_documents(docs), "text", count_col="n_chars")


def mix_sources(spark, docs, sf_dir):
    """Documents as often as the mix takes them."""
    return mixing.repeat(_documents(docs), workspace=Workspace(spark, "pipeline-mix"))


def encode(spark, docs, sf_dir):
    """Ids of the tokens of every document of the mix."""
    return bpe.encode(docs, "doc_id", "text", with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: The encoding and the sketches are beyond SQL: the pipeline is tested against a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
