"""Each registered query over whole small tables: against its oracle where it has one, else against plain versions."""

import hashlib
import os
import re

import duckdb
import pytest

from pressline.llm import bpe, html_extract, registry, secret_scan

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
TABLES = "documents embeddings pages labels".split()


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(value):
    return "-" if value is None else f"{value:.9g}" if isinstance(value, float) else str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracles(spark, tables, name):
    df = registry.queries()[name](spark, SF)
    want = tables.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_op1(spark, tables):
    pages = tables.sql("SELECT page_id, html FROM pages").fetchall()
    last = {}
    for i, t in sorted(pages):
        last[t or ""] = i
    want = sorted((i, len((t or "").encode()), None if last[t or ""] == i else last[t or ""]) for i, t in pages)
    got = registry.op1_warc(spark, SF).select("page_id", "payload_bytes", "refers_to", "payload_digest", "record_type").collect()
    assert sorted(tuple(r)[:3] for r in got) == want
    assert all(re.fullmatch("[A-Z2-7]{32}", r["payload_digest"]) and (r["record_type"] == "revisit") == (r["refers_to"] is not None) for r in got)


def test_op2(spark, tables):
    from tests.llm.test_tables import brute_components

    docs = tables.sql("SELECT doc_id, text FROM documents").fetchall()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in registry.op2_minhash_dedup(spark, SF).collect()}
    assert got == brute_components(docs, 4)


def test_op3(spark, tables):
    want = sorted((i, u, html_extract.extract(h or "")) for i, u, h in tables.sql("SELECT page_id, url, html FROM pages").fetchall())
    got = registry.op3_html_extract(spark, SF).select("page_id", "url", "text", "n_chars").collect()
    assert sorted(tuple(r)[:3] for r in got) == want and all(r["n_chars"] == len(r["text"]) for r in got)
    # the article of these pages, by the marks that the generator puts around it
    for i, _, h in tables.sql("SELECT page_id, url, html FROM pages").fetchall():
        body = re.search("(?s)<article>(.*?)</article>", h)[1]
        import html

        want_text = " ".join(html.unescape(re.sub("<[^>]*>", lambda m: " " if re.match("</?(p|h1|br|div|ul|li)", m[0]) else "", body)).split())
        assert next(r["text"] for r in got if r["page_id"] == i) == want_text


def test_op4(spark, tables):
    from tests.llm.test_texts import brute_random, brute_spans

    enc = bpe.encoding(bpe.default_rank_file(), bpe.default_pattern())
    got = {r["doc_id"]: r for r in registry.op4_secret_scan(spark, SF).collect()}
    for i, t in tables.sql("SELECT doc_id, text FROM documents").fetchall():
        base = brute_spans(t or "")
        every = sorted(base + brute_random(t or "", enc, base))
        line = lambda spans: ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        r = got[i]
        assert (r["base_sha256"], r["spans"]) == (hashlib.sha256(line(base).encode()).hexdigest(), line(every))
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == n for _, k, _ in base) for n in range(3))


def test_op5(spark, tables):
    enc = bpe.encoding(bpe.default_rank_file(), bpe.default_pattern())
    got = {r["doc_id"]: r for r in registry.op5_byte_bpe(spark, SF).collect()}
    for i, t in tables.sql("SELECT doc_id, text FROM documents").fetchall():
        ids = enc.encode_ordinary(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_op10(spark, tables):
    from tests.llm.test_texts import brute_measure, brute_rules

    docs = tables.sql("SELECT doc_id, text, lang FROM documents").fetchall()
    want = brute_rules(docs, tables.sql("SELECT doc_id, quality FROM labels").fetchall())
    for r in registry.op10_quality_rules(spark, SF).collect():
        text = next(t for i, t, _ in docs if i == r["doc_id"]) or ""
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_measure(text)
        assert r["kept"] == want[r["doc_id"]]
