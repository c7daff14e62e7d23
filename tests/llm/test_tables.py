"""Operators over tables: WARC, near-dedup, mixing, top-k, URL filters; and the pipeline, against plain versions."""

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressline.llm import minhash, mixing, topk, url_filter, warc
from pressline.llm.common import WordHash

# ---------------------------------------------------------------- WARC

PAGES = "page_id long, url string, html string, payload_bytes string"


def sha(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_warc_round_trip(spark, ws):
    big = "<p>é" * 400_000
    data = [(1, "http://a/1", "<p>x", "k"), (2, "http://a/2\r\nX: y", "<p>x", "k"), (3, None, None, "k"), (4, "u", "", "k"), (5, "u", big, "k"), (6, "u", "WARC/1.1\r\n\r\n", "k"), (None, "u", "<p>x", "k"), (None, "u", "alone", "k"), (7, "u", "twice", "k"), (7, "u", "twice", "k")]
    warc.write(spark.createDataFrame(data, PAGES).repartition(3), ws.sub("w"), workspace=ws)
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.pages(warc.read(spark, ws.sub("w"))).collect())
    size = lambda t: len((t or "").encode())
    want = sorted(
        (i or 0, size(t), sha(t or ""), "response" if ref is None else "revisit", ref)
        for i, t, ref in [(1, "<p>x", 2), (2, "<p>x", None), (3, None, 4), (4, "", None), (5, big, None), (6, data[5][2], None), (None, "<p>x", 2), (None, "alone", None), (7, "twice", None), (7, "twice", None)]
    )
    assert got == want
    plain = b"".join(gzip.decompress(bytes(r["content"])) for r in spark.read.format("binaryFile").load(ws.sub("w")).collect())
    assert plain.count(b"WARC-Type: revisit") == 3
    warc.write(spark.createDataFrame([], PAGES), ws.sub("none"), workspace=ws)
    assert warc.read(spark, ws.sub("none")).count() == 0


def test_small_payloads_are_all_responses(spark, ws):
    warc.write(spark.createDataFrame([(1, "u", "ab", ""), (2, "u", "ab", ""), (3, "u", "abc", ""), (4, "u", "abc", "")], PAGES), ws.sub("w"), min_bytes=3, workspace=ws)
    assert {r["page_id"]: r["refers_to"] for r in warc.pages(warc.read(spark, ws.sub("w"))).collect()} == {1: None, 2: None, 3: 4, 4: None}


def archive(n, packed):
    raws = [warc.page_record(i, f"http://a/{i}", f"<p>page {i} {'x' * i}".encode(), 9, sha(f"<p>page {i} {'x' * i}"), None) for i in range(n)]
    return [warc.member(r) if packed else r for r in raws]


def ids(found):
    return [int(re.search("page:([0-9]+)", x.headers["warc-record-id"])[1]) for x in found if isinstance(x, warc.Record)]


def inflated(member):
    """What the deflate stream of a member gives, byte by byte up to its break."""
    d, out = zlib.decompressobj(-15), b""
    for i in range(10, len(member)):
        try:
            out += d.decompress(member[i : i + 1])
        except zlib.error:
            break
    return out


def assert_covered(found, raw):
    """Recovered stretches and gaps hold every byte once."""
    at = 0
    for offset, length in sorted({(x.offset, x.length) for x in found}):
        assert offset == at
        at += length
    assert at == len(raw)


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    parts = archive(12, packed)
    whole = b"".join(parts)
    assert ids(warc.salvage(whole)) == list(range(12))
    assert not [x for x in warc.salvage(whole) if isinstance(x, warc.Gap)]
    rng = random.Random(7)
    for _ in range(60):
        hurt = rng.randrange(12)
        part = bytearray(parts[hurt])
        kind = rng.choice(["flip", "cut", "junk"])
        if kind == "flip":
            part[rng.randrange(10, len(part)) if packed else part.find(b"<p>") + 3] ^= 0x55
        elif kind == "cut":
            del part[len(part) // 2 :]
        else:
            part = bytearray(b"junk \x1f\x8b WARC/1. " * 3) + part
        raw = b"".join(parts[:hurt]) + bytes(part) + b"".join(parts[hurt + 1 :])
        found = list(warc.salvage(raw))
        # a member that breaks after its record has the record whole
        whole_still = kind == "junk" or (packed and kind == "flip" and isinstance(warc.parse(inflated(bytes(part)), 0), warc.Record))
        assert ids(found) == [i for i in range(12) if i != hurt or whole_still]
        gaps = [x for x in found if isinstance(x, warc.Gap)]
        before = sum(map(len, parts[:hurt]))
        assert gaps and all(g.reason for g in gaps) and (gaps[0].offset == before or (whole_still and gaps[0].offset > before))
        assert_covered(found, raw)


def test_salvage_inside_a_member_of_several_records(spark, tmp_path):
    parts = archive(12, False)
    long = [p.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 9", 1) if i == 5 else p for i, p in enumerate(parts)]
    flipped = [p.replace(b"<p>", b"<q>") if i in (0, 5, 11) else p for i, p in enumerate(parts)]
    assert long[5] != parts[5]
    for hurt, lost in ((long, [5]), (flipped, [0, 5, 11]), (parts[:5] + [b"junk WARC/1. "] + parts[5:], [])):
        one = warc.member(b"".join(hurt))
        raw = warc.SEPARATOR + one + warc.member(parts[3])
        found = list(warc.salvage(raw))[1:]
        assert ids(found) == [i for i in range(12) if i not in lost] + [3]
        gaps = [x for x in found if isinstance(x, warc.Gap)]
        assert len(gaps) == max(1, len(lost)) and {(g.offset, g.length) for g in gaps} == {(len(warc.SEPARATOR), len(one))}
        starts = [sum(map(len, hurt[:i])) for i in lost or [5]]
        assert [tuple(map(int, re.search("bytes ([0-9]+) to ([0-9]+) of", g.reason).groups())) for g in gaps] == [(s, s + len(hurt[i])) for s, i in zip(starts, lost or [5], strict=True)]
        (tmp_path / "a.warc.gz").write_bytes(raw)
        rows = warc.read(spark, str(tmp_path)).collect()
        assert sum(r["gap"] is None for r in rows) == len(found) + 1 - len(gaps)
    # the member breaks off after a bad record: what was inflated is searched as well
    cut = warc.member(b"".join(flipped[:6] + parts[6:]) + random.Random(5).randbytes(60_000))[:40_000]
    found = list(warc.salvage(cut + warc.member(parts[3])))
    assert ids(found) == [*range(1, 5), *range(6, 12), 3]
    gaps = [x for x in found if isinstance(x, warc.Gap)]
    assert [g.reason.split(";")[0] for g in gaps[:2]] == ["payload digest differs"] * 2 and "inflated member on" in gaps[2].reason and 0 < gaps[2].offset == gaps[0].length == len(cut) - gaps[2].length


@pytest.mark.parametrize("level", [0, 1, 9])
@pytest.mark.parametrize("n", [1, 3, 201])
def test_broken_members_give_each_record_once(level, n):
    """Stored, small and large members with a bad checksum, a bad size, or cut: no record twice, none of the whole ones lost."""
    parts = archive(n, False)
    one = gzip.compress(b"".join(parts), level, mtime=0)
    for broken in (one[:-8] + b"\0" * 8, one[:-1] + b"\x77", one[:-4], one[:-8]):
        raw = warc.SEPARATOR + broken + warc.member(parts[0])
        found = list(warc.salvage(raw))[1:]
        assert ids(found) == [*range(n), 0]
        assert_covered([warc.Gap(0, len(warc.SEPARATOR), "x"), *found], raw)
    if n > 3:
        hurt = bytearray(one)
        hurt[len(one) // 2] ^= 0x10
        found = list(warc.salvage(bytes(hurt)))
        got = ids(found)
        assert len(got) == len(set(got)) and got[: n // 3] == list(range(n // 3))
        assert_covered(found, bytes(hurt))


def test_header_values_that_look_like_version_lines():
    def rec(i, *more):
        return warc.record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:page:{i}>"), *more], b"x" * i)

    for value in ("http://a/WARC/1.1", "WARC/1.0", "http://a/?WARC/1.0 WARC/1.1"):
        parts = [rec(0), rec(1, ("WARC-Target-URI", value)), rec(2, ("X", "one\r\n two"))]
        for raw in (b"".join(parts), b"".join(map(warc.member, parts)), warc.member(b"".join(parts))):
            found = list(warc.salvage(raw))
            assert ids(found) == [0, 1, 2] and not any(isinstance(x, warc.Gap) for x in found)
            assert found[1].headers["warc-target-uri"] == value and found[2].headers["x"] == "one two"
    # a record that is cut inside its headers runs into the next one's, wherever it is cut
    first = rec(1, ("WARC-Target-URI", "http://a/b"))
    head = first.index(b"\r\n\r\n")
    for cut in range(1, head + 2):
        found = list(warc.salvage(rec(0) + first[:cut] + rec(2)))
        assert ids(found) == [0, 2], cut


def test_salvage_is_linear_in_hostile_archives():
    import time

    for unit, n in ((b"\x1f\x8b\x08", 200_000), (b"WARC/1.", 200_000), (b"X: WARC/1.1\r\n", 100_000), (b"WARC/1.1\r\nA: b\r\n", 100_000), (b"WARC/1.1\r\nContent-Length: 9\r\n\r\n", 50_000)):
        start = time.time()
        found = list(warc.salvage(b"x" + unit * n))
        assert len(found) == 1 and found[0].length == len(unit) * n + 1
        assert time.time() - start < 20, unit


def test_registered_query_gives_every_page(spark, tmp_path):
    from pressline.llm import registry

    rows = [(i, f"http://a{i}.com/{'WARC/1.1' if i % 7 == 0 else 'x'}", None if i % 11 == 0 else f"<p>{i % 40}</p>" * (1 + i % 5)) for i in range(300)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    last = {}
    for i, _, t in rows:
        last[t or ""] = i
    want = [(i, len((t or "").encode()), sha(t or ""), "response" if last[t or ""] == i else "revisit", None if last[t or ""] == i else last[t or ""]) for i, _, t in rows]
    got = registry.op1_warc(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == want


def test_salvage_of_nothing():
    assert list(warc.salvage(b"")) == []
    assert list(warc.salvage(b"\x1f\x8b\x08 no")) and isinstance(next(iter(warc.salvage(b"zzz"))), warc.Gap)


# ---------------------------------------------------------------- near-dedup


def brute_components(docs, k):
    sets = {}
    for i, t in docs:
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))} if words else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(rng, n):
    """Groups of texts edited from a base, so much that many pairs are on either side of the threshold."""
    docs, i = [], 0
    while len(docs) < n:
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 6, 40, 90]))]
        for _ in range(rng.choice([1, 2, 12])):
            words = list(base)
            for _ in range(rng.randrange(5)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            docs.append((i, " ".join(words).upper() if rng.random() < 0.1 else "\t".join(words)))
            i += rng.randrange(1, 4)
    rng.shuffle(docs)
    return docs


def test_near_duplicates(spark, ws):
    docs = near_copies(random.Random(8), 260) + [(9000, None), (9001, ""), (9002, " \n"), (9003, "One two"), (9004, "one  TWO"), (9005, "long " * 30000), (9006, "long " * 30000)]
    want = brute_components(docs, 4)
    df = spark.createDataFrame([(i, t, 0) for i, t in docs] + [(None, docs[0][1], 0)], "doc_id long, text string, n int")
    rows = minhash.near_duplicates(df, shingle=4, workspace=ws).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None}
    assert got == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    assert len({c for _, c in want.values()}) < len(docs) - 20


def test_near_duplicates_of_one_large_group(spark, ws):
    """Copies of a base that is not there itself, some past every link: each pair of the bucket is settled."""
    rng = random.Random(10)
    base, docs = [f"w{i}" for i in range(60)], []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(60), rng.choice([1, 1, 2, 3])):
            words[at] = f"e{rng.randrange(40)}"
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, shingle=4, workspace=ws).collect()}
    assert got == brute_components(docs, 4)


def test_repeated_rows_and_empty_tables(spark, ws):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, minhash.near_duplicates(df, workspace=ws).collect())) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    assert minhash.near_duplicates(df.limit(0), workspace=ws).collect() == []


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(11)
    for size in (1, 2, 7, 100, 5000):
        s = np.unique(rng.integers(0, 2**63, size, dtype=np.int64).astype(np.uint64))
        out = minhash.sketch(s)
        assert len(out) == minhash.COORDINATES and (out > 0).all()
        assert (out == minhash.sketch(s)).all()
    a = np.unique(rng.integers(0, 2**63, 2000, dtype=np.int64).astype(np.uint64))
    b = np.unique(np.concatenate([a[:1600], rng.integers(0, 2**63, 400, dtype=np.int64).astype(np.uint64)]))
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((minhash.sketch(a) == minhash.sketch(b)).mean() - j) < 4 * math.sqrt(j * (1 - j) / minhash.COORDINATES)


def test_lower_case_is_ascii_only():
    t = WordHash()
    assert (minhash.shingles("ÄB cd".encode(), 1, t) == minhash.shingles("Äb CD".encode(), 1, t)).all()
    assert not (minhash.shingles("Ä".encode(), 1, t) == minhash.shingles("ä".encode(), 1, t)).any()


# ---------------------------------------------------------------- mixing


def brute_targets(sizes, weights=(5, 2, 1), percent=150, cap=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values()) * percent / 100
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing(spark, ws):
    rng = random.Random(12)
    docs = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.choice([0, 1, 5, 60, 900]))), rng.choice(["a"] * 6 + ["b", "B", "é", None, "zz"])) for i in range(500)] + [(900, None, "a"), (901, "  ", "empty"), (902, "w " * 50000, "b")]
    df = spark.createDataFrame([(*d, 3) for d in docs], "doc_id long, text string, source string, size int")
    rows = mixing.mix(df, workspace=ws).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(df.repartition(5), workspace=ws).collect()))
    source = {i: s for i, _, s in docs}
    size = {i: len((t or "").split()) for i, t, _ in docs}
    assert {r["doc_id"]: r["size"] for r in rows} == size
    whole, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        whole[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = brute_targets(whole)
    for r in rows:
        assert r["source_size"] == whole[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]], rel=1e-9)
    assert all(taken[s] == math.floor(want[s] + 1e-9) for s in want)
    assert sum(taken.values()) == pytest.approx(1.5 * sum(whole.values()), abs=len(want))
    assert mixing.mix(df.limit(0), workspace=ws).collect() == []


# ---------------------------------------------------------------- top-k


def brute_top(vectors, k, scale=1024):
    """vectors: (id, vector) rows; queries are the distinct rows of ids divisible by 100, which share a list by id."""
    rows = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    scores = defaultdict(list)
    for a, q in {r for r in rows if r[0] % 100 == 0}:
        scores[a] += [(-sum(x * y for x, y in zip(q, c, strict=True)), b) for b, c in rows if b != a and len(c) == len(q)]
    return sorted((a, r + 1, b, -s) for a, found in scores.items() for r, (s, b) in enumerate(sorted(found)[:k]))


def search(spark, ws, data, k=10, **more):
    df = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<double>, score string")
    return sorted(tuple(r) for r in topk.top_k(df, df.filter("vec_id % 100 = 0"), k=k, workspace=ws, **more).collect())


def test_top_k(spark, ws):
    rng = random.Random(13)
    data = [(i, [rng.gauss(0, 0.2) for _ in range(7)]) for i in range(0, 900)]
    data += [(1000 + i, [0.5] * 7) for i in range(40)] + [(2000, None), (2001, [None] * 7), (2002, [float("nan")] * 7), (2003, [float("inf")] * 7), (None, [0.1] * 7), (2100, [1.0, 2.0]), (2101, [1.0, 3.0]), (2200, []), (2201, [])]
    # a whole row twice, one id with two vectors, as query and as candidate
    data += [data[100], data[5], (200, data[7][1]), (7, [0.4] * 7)]
    assert search(spark, ws, data) == brute_top(data, 10)
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert topk.top_k(df.limit(0), df.limit(0), workspace=ws).collect() == []
    assert topk.top_k(df, df.limit(0), workspace=ws).collect() == []
    few = df.filter("vec_id in (0, 1, 2)")
    assert [r["rank"] for r in topk.top_k(few, few.filter("vec_id = 0"), workspace=ws).orderBy("rank").collect()] == [1, 2]


def test_top_k_skips_most_pairs_of_clustered_vectors(spark, ws):
    rng = np.random.default_rng(14)
    centres = rng.normal(0, 1, (20, 16))
    x = centres[rng.integers(0, 20, 4000)] + rng.normal(0, 0.03, (4000, 16))
    x[:1300] = centres[0] + rng.normal(0, 0.03, (1300, 16))  # a hot cluster
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    made = spark.sparkContext.accumulator(0)
    assert search(spark, ws, data, counter=made) == brute_top(data, 10)
    assert 0 < made.value < 0.35 * 40 * 4000, made.value


def test_top_k_of_hostile_vectors(spark, ws, monkeypatch):
    """Blocks and chunks of a few rows, zero vectors, equal vectors, negative scores, components near 64 bits."""
    monkeypatch.setattr(topk, "BLOCK", 7)
    monkeypatch.setattr(topk, "CHUNK", 3)
    rng = random.Random(15)
    data = [(i, [-1.0 - rng.random() for _ in range(4)]) for i in range(150)] + [(1000 + i, [0.0] * 4) for i in range(30)] + [(2000 + i, [1.0, -1.0, 1.0, -1.0]) for i in range(25)]
    assert search(spark, ws, data, k=3) == brute_top(data, 3)
    big = [(i, [rng.choice([-1, 1]) * 2.0 ** rng.randrange(20, 50) for _ in range(3)]) for i in range(0, 400, 20)]
    want = [(a, r, b, max(-(2**63), min(2**63 - 1, s))) for a, r, b, s in brute_top(big, 30)]
    assert {x[:1] + x[2:] for x in search(spark, ws, big, k=30)} == {x[:1] + x[2:] for x in want}


def test_large_components_stay_exact():
    q = np.array([[2**40, -(2**40), 3]], np.int64)
    c = np.array([[2**41, 5, 7], [1, 1, 1]], np.int64)
    parts = topk.partial_scores(q, c, 2)
    assert [int(sum(p[0][j] for p in parts)) for j in range(2)] == [2**81 - 5 * 2**40 + 21, 3]


# ---------------------------------------------------------------- URL filters


def test_url_rules_and_reputation(spark, ws):
    urls = ["http://a.com/x", "https://Example.COM/en/1", "https://www.example.com/en/1", "https://sub.www.example.com/en/?q", "http://x.net/es/1", "http://x.net/de/1", "http://xnet/es/1", None, "no scheme", "://", "http://host", "ftp://a.com#x", "a://b://c/d", "http://notexample.com/en/1", "http://bad.org/1", "http://new.bad.org/1", "http://fine.org/1", "http://a.org\n/x"]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, rule string")
    outcomes = spark.createDataFrame([("bad.org", 1)] * 60 + [("fine.org", 0)] * 60 + [("one.org", 1)] + [("x.org", 0)] * 40 + [("bad.org", None), ("", 1)], "host string, bad int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, outcomes, workspace=ws).collect()}
    assert got == {
        0: ("a.com", "/x", "com/", "allow"), 1: ("example.com", "/en/1", "example.com/en/", "block"), 2: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 3: ("sub.www.example.com", "/en/", "www.example.com/en/", "allow"),
        4: ("x.net", "/es/1", "net/es/", "block"), 5: ("x.net", "/de/1", None, "allow"), 6: ("xnet", "/es/1", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("host", "", None, "allow"),
        11: ("a.com", "", None, "allow"), 12: ("b:", "//c/d", None, "allow"), 13: ("notexample.com", "/en/1", "com/", "allow"), 14: ("bad.org", "/1", None, "block"), 15: ("new.bad.org", "/1", None, "block"), 16: ("fine.org", "/1", None, "allow"), 17: ("a.org\n", "/x", None, "allow"),
    }
    rep = {r["host"]: r for r in url_filter.reputation(outcomes, ws)[0].collect()}
    assert rep["bad.org"]["post_low"] > 0.5 > rep["one.org"]["post_low"]
    none = url_filter.judge(df, outcomes.limit(0), workspace=ws)
    assert none.filter("verdict = 'block'").count() == 2
    assert url_filter.judge(df.limit(0), outcomes, workspace=ws).collect() == []


def test_shrinkage_follows_the_chain(spark, ws):
    rows = [(f"h{i}.evil.org", 1) for i in range(30)] + [(f"h{i}.good.org", 0) for i in range(30)] + [("new.evil.org", 0), ("new.good.org", 1)]
    hosts, domains, _, _ = url_filter.reputation(spark.createDataFrame(rows, "host string, bad int"), ws)
    rep = {r["host"]: r["post_mean"] for r in hosts.collect()}
    assert rep["new.evil.org"] > rep["new.good.org"]
    low = {r["domain"]: r["low"] for r in domains.collect()}
    assert low["evil.org"] > 0.5 > low["good.org"]
    *frames, (mean, low) = url_filter.reputation(spark.createDataFrame([], "host string, bad int"), ws)
    assert [df.count() for df in frames] == [0, 0, 0] and mean == 0.5 and 0.4 < low < 0.5


def test_beta_quantiles(spark):
    """Against draws of the distribution: the share below the bound is the tail."""
    rng = np.random.default_rng(20)
    cases = [(0.14, 1000.0), (0.14, 0.86), (1.0, 1.0), (3.0, 9.0), (40.0, 2.0), (900.0, 100.0), (5e5, 2e6)]
    df = spark.createDataFrame(cases, "a double, b double")
    for tail in (0.05, 0.25):
        for r in df.select("a", "b", url_filter.beta_low(F.col("a"), F.col("b"), tail).alias("low")).collect():
            draws = rng.beta(r["a"], r["b"], 200_000)
            assert abs((draws < r["low"]).mean() - tail) < 0.005, r


def test_keys_of_reputation(spark):
    hosts = {"a.b.co.uk:8080": ("b.co.uk", "co.uk"), "user@x.example.com.": ("example.com", "com"), "10.0.0.1:80": ("10.0.0.1", "numbers"), "[::1]:80": ("[::1]", "numbers"), "me.github.io": ("me.github.io", "github.io"), "co.uk": ("co.uk", "co.uk"), "a.com.au": ("a.com.au", "com.au"), "localhost": ("localhost", "localhost"), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string").withColumn("key", url_filter.reputation_key(F.col("host")))
    assert {r[0]: (r[1], r[2]) for r in df.select("host", url_filter.domain_of(F.col("key")), url_filter.suffix_of(F.col("key"))).collect()} == hosts


def planted_hosts(rng, n):
    """Outcomes of hosts of which a tenth has mostly bad pages, and the hosts' shares."""
    share = {f"h{i}.d{i % 40}.org": (rng.uniform(0.75, 0.98) if rng.random() < 0.1 else rng.uniform(0.0, 0.2)) for i in range(n)}
    return [(h, int(rng.random() < p)) for h, p in share.items() for _ in range(rng.choice([1, 3, 8, 30]))], share


def test_calibrated_blocks_are_right(spark, ws):
    rng = random.Random(21)
    outcomes, share = planted_hosts(rng, 400)
    pages = [(i, f"http://{h}/x") for i, h in enumerate(share)]
    judged = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "host string, bad int"), workspace=ws)
    blocked = {r["host"] for r in judged.filter("verdict = 'block'").collect()}
    bad = {h for h, p in share.items() if p > 0.5}
    seen = {h for h in bad if sum(o[0] == h for o in outcomes) >= 3}
    assert len(blocked & bad) >= 0.95 * len(blocked) and len(blocked & seen) >= 0.8 * len(seen)
    # outcomes that do not depend on hosts block nothing
    even = [(h, int(rng.random() < 0.14)) for h in share for _ in range(6)]
    none = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(even, "host string, bad int"), workspace=ws)
    assert none.filter("verdict = 'block'").count() == 0
    # a dearer good page blocks less, a cheaper one more
    hosts = url_filter.reputation(spark.createDataFrame(outcomes, "host string, bad int"), ws)[0]
    assert url_filter.calibrated(hosts, 0.2) <= url_filter.calibrated(hosts, 1.0) <= url_filter.calibrated(hosts, 20.0)


def brute_cutoff(hosts):
    costs = [(sum((r["n"] - r["bad"]) * ((r["low_less_good"] or 0) >= x) - r["bad"] * ((r["low_less_bad"] or 0) >= x) for r in hosts), -x) for x in url_filter.CUTOFFS]
    best, at = min(costs)
    return -at if best < 0 else url_filter.NEVER


def test_cutoff_against_brute_force(spark, ws):
    for seed in (1, 2, 3):
        outcomes, _ = planted_hosts(random.Random(seed), 60)
        hosts = url_filter.reputation(spark.createDataFrame(outcomes, "host string, bad int"), ws)[0]
        assert url_filter.calibrated(hosts) == brute_cutoff(hosts.collect())


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp
    from pressline.llm import bpe

    rng = random.Random(14)
    prose = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    docs = [(i, prose(80), "en", f"s{i % 3}") for i in range(120)]
    docs += [(200, docs[0][1], "en", "s0"), (201, docs[1][1] + " end", "en", "s1"), (202, "few words", "en", "s1"), (203, "same " * 90, "en", "s2"), (204, prose(70) + " token = abcdefgh12345 " + prose(10), "en", "s2"), (205, None, None, None), (0, docs[0][1], "en", "s0")]
    df = spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_dedup", "secret_scans", "mix_sources", "encode"]
    now, seen = df, {}
    for name, stage in cp.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "encode":
            assert out.columns == list(cp.COLUMNS)
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = now.collect()
    kept = {r["doc_id"] for r in seen["quality_rules"]}
    assert kept == {*range(120), 200, 201, 204} and len(seen["quality_rules"]) == 124
    unique = sorted(r["doc_id"] for r in seen["near_dedup"])
    assert unique == [*range(120), 204]
    masked = {r["doc_id"]: r for r in seen["secret_scans"]}
    assert "[assign removed]" in masked[204]["text"] and masked[204]["n_chars"] == len(masked[204]["text"])
    assert all(masked[i]["text"] == docs[i][1] for i in range(120))
    words = defaultdict(int)
    for r in seen["secret_scans"]:
        words[r["source"]] += len(r["text"].split())
    want, got = brute_targets(words), defaultdict(int)
    for r in seen["mix_sources"]:
        got[r["source"]] += len(r["text"].split())
    assert all(abs(got[s] - want[s]) <= 100 for s in want)
    enc = bpe.encoding(bpe.default_rank_file(), bpe.default_pattern())
    assert sorted(map(tuple, seen["encode"]), key=str) == sorted(((r["doc_id"], len(x), x) for r in seen["mix_sources"] for x in [enc.encode_ordinary(r["text"])]), key=str)
    assert sorted(map(tuple, cp.run(spark, str(tmp_path)).collect()), key=str) == sorted(map(tuple, seen["encode"]), key=str)


def test_sieve_holds_its_ids_and_few_others(spark, ws):
    from pressline.llm.common import Sieve

    rng = random.Random(30)
    ids = {rng.randrange(10**12) for _ in range(3000)}
    others = {rng.randrange(10**12) for _ in range(20000)} - ids
    held = Sieve(ws, spark.createDataFrame([(i,) for i in ids], "node long"), "s")
    df = spark.createDataFrame([(i, i in ids) for i in ids | others] + [(None, False)], "doc_id long, there boolean")
    got = {(r["there"], r["__held"]): r["count"] for r in held.mark(df, "doc_id").groupBy("there", "__held").count().collect()}
    assert got[True, True] == len(ids) and (True, False) not in got and got[False, True] < 0.1 * len(others)
    none = Sieve(ws, spark.createDataFrame([], "node long"), "none")
    assert none.mark(df, "doc_id").filter("__held").count() == 0


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)]])
def test_pipeline_of_nothing(spark, tmp_path, rows):
    import corpus_pipeline as cp

    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_mixing_of_hot_and_missing_ids(spark, ws):
    """A third of the rows with one id, another with none: equal rows get equal shares, the words are right but for the group at the cut."""
    docs = [(5, "a b c", "s")] * 300 + [(None, f"w{i} x", "s") for i in range(300)] + [(1000 + i, "d e", "s" if i % 2 else "t") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(df, workspace=ws).collect()
    assert len(rows) == len(docs) and len({(r["size"], r["taken"]) for r in rows if r["doc_id"] == 5}) == 1
    assert sum(r["taken"] > r["epochs"] * r["size"] for r in rows if r["doc_id"] is None) not in (0, 300)
    sources = {(r["source_size"], r["target"]) for r in rows}
    taken = defaultdict(int)
    for r in rows:
        taken[r["source_size"]] += r["taken"]
    assert all(0 <= math.floor(t) - taken[s] <= 300 for s, t in sources)
    copies = defaultdict(int)
    for r in mixing.repeat(df, workspace=ws).collect():
        copies[r["source"]] += len(r["text"].split())
    size = {s: sum(len(t.split()) for _, t, x in docs if x == s) for s in "st"}
    assert all(abs(copies[s] - dict(sources)[size[s]]) <= 450 for s in "st")


def test_work_folders_need_a_shared_place_on_a_cluster(spark):
    from pressline.llm.common import Workspace

    fake = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: {}, master="spark://x:7077"))
    with pytest.raises(ValueError):
        Workspace(fake, "x")
    assert F is not None


def test_salvage_bounds_false_starts_of_members():
    """Repeated member headers whose stored blocks end in a bad code: one gap, in a few passes; records before and behind stay."""
    import struct
    import time

    head = b"\x1f\x8b\x08\x00" + b"\0" * 6
    good = warc.salvage  # the same reader as of whole archives
    began = time.time()
    for size in (8000, 65535):
        unit = head + b"\x00" + struct.pack("<HH", size, size ^ 0xFFFF)
        for tail in (b"", b"\xff" * 40):
            raw = ((unit * (size // len(unit) + 1))[: size + len(unit)] + tail) * (1_000_000 // size)
            got = list(good(raw))
            assert len(got) == 1 and got[0].length == len(raw) and got[0].reason
    assert time.time() - began < 30


def test_break_and_place_are_those_of_single_bytes():
    """Halving finds the byte that reading one by one finds."""
    import zlib

    rng = random.Random(23)
    for _ in range(60):
        plain = bytes(rng.choices(b"abcdefgh", k=rng.randrange(1, 60_000)))
        made = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = bytearray(b"\x1f\x8b\x08\x00" + b"\0" * 6 + made.compress(plain) + made.flush())
        for _ in range(rng.randrange(3)):
            body[rng.randrange(10, len(body))] ^= 1 << rng.randrange(8)
        raw = bytes(body) + zlib.crc32(plain).to_bytes(4, "little") + len(plain).to_bytes(4, "little")
        d, out, i = zlib.decompressobj(-15), bytearray(), 10
        fault = False
        counts = []
        while i < len(raw) and not d.eof:
            try:
                out += d.decompress(raw[i : i + 1])
            except zlib.error:
                fault = True
                break
            i += 1
            counts.append((i, len(out)))
        member = warc.inflate(raw, 0)
        if fault:
            assert (member.plain, member.after) == (bytes(out), i) and member.wrong.startswith("member fails")
        elif d.eof and len(raw) >= i + 8:
            assert member.plain == bytes(out) and member.after == i + 8
        for size in {1, len(out) // 2, len(out)} - {0}:
            assert warc.place_of(raw, 0, size) == next(at for at, n in counts if n >= size)
