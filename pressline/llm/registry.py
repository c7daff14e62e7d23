"""The training-data operators as named queries, one for each operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressline.llm import bpe, hard_negatives, html_extract, langid, merkle, minhash, mixing, quality, secret_scan, token_files, topk, url_filter, warc
from pressline.llm.common import Workspace


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark, sf_dir):
    ws = Workspace(spark, "op1")
    warc.write(_read(spark, sf_dir, "pages"), ws.sub("archives"), workspace=ws)
    return warc.pages(warc.read(spark, ws.sub("archives"), blocks=False))


def op2_minhash_dedup(spark, sf_dir):
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), shingle=4, percent=80, workspace=Workspace(spark, "op2"))


def op3_html_extract(spark, sf_dir):
    return html_extract.main_text(_read(spark, sf_dir, "pages"))


def op4_secret_scan(spark, sf_dir):
    return secret_scan.digest(secret_scan.scan(_read(spark, sf_dir, "documents"), "doc_id", "text", with_text=False), "doc_id")


def op5_byte_bpe(spark, sf_dir):
    return bpe.encode(_read(spark, sf_dir, "documents"), "doc_id", "text", with_ids=False, digests=True)


def op6_mixing(spark, sf_dir):
    return mixing.mix(_read(spark, sf_dir, "documents"), workspace=Workspace(spark, "op6")).select("doc_id", "size", "source_size", "target", "taken")


def op7_topk(spark, sf_dir):
    rows = _read(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.filter("vec_id % 100 = 0"), workspace=Workspace(spark, "op7"))


def op8_language_id(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    model = langid.train(docs.filter(langid.learning_part(F.col("doc_id"))), id_col="doc_id", text_col="text", label_col="lang")
    held = (~langid.learning_part(F.col("doc_id")) & F.col("doc_id").isNotNull()).alias("held_out")
    return langid.predict(docs, model, id_col="doc_id", text_col="text").select("doc_id", held, "lang_pred", "score", "ambiguous")


def page_outcomes(spark, sf_dir):
    """A page is a rendering of the document whose number its path names: that one's quality label is its outcome."""
    number = F.expr(r"try_cast(regexp_extract(url, '://[^/]*/[^/]*/([0-9]{1,18})', 1) as bigint)")
    named = _read(spark, sf_dir, "pages").select(url_filter.host_of(F.col("url")).alias("host"), number.alias("doc_id"))
    return named.join(_read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").select("host", (1 - F.col("quality")).alias("bad"))


def op9_url_filter(spark, sf_dir):
    judged = url_filter.judge(_read(spark, sf_dir, "pages"), page_outcomes(spark, sf_dir), workspace=Workspace(spark, "op9"))
    return judged.withColumns({c: F.round(c, 6) for c in ("bad_mean", "bad_low")})


def op10_quality_rules(spark, sf_dir):
    judged = quality.rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), workspace=Workspace(spark, "op10"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("junk_score", 6).alias("junk_score"))


def op11_merkle(spark, sf_dir):
    rows = merkle.manifest(_read(spark, sf_dir, "documents"), claim=merkle.without_newlines(), workspace=Workspace(spark, "op11"))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op12_token_files(spark, sf_dir):
    path = Workspace(spark, "op12").sub("corpus")
    token_files.write(_read(spark, sf_dir, "documents"), path)
    return token_files.checksums(token_files.read(spark, path))


def op13_hard_negatives(spark, sf_dir):
    rows = _read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows, rows.filter("vec_id % 100 = 0"), label=label, workspace=Workspace(spark, "op13"))


def queries():
    return {
        "op1_warc": op1_warc,
        "op2_minhash_dedup": op2_minhash_dedup,
        "op3_html_extract": op3_html_extract,
        "op4_secret_scan": op4_secret_scan,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_mixing": op6_mixing,
        "op7_topk": op7_topk,
        "op8_language_id": op8_language_id,
        "op9_url_filter": op9_url_filter,
        "op10_quality_rules": op10_quality_rules,
        "op11_merkle": op11_merkle,
        "op12_token_files": op12_token_files,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql():
    return {"op6_mixing": mixing.ORACLE, "op7_topk": topk.ORACLE, "op9_url_filter": url_filter.ORACLE, "op11_merkle": merkle.ORACLE, "op13_hard_negatives": hard_negatives.ORACLE}
