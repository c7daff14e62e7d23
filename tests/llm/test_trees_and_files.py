"""Merkle manifest, token files and hard negatives against plain versions, and their edge cases."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressline.llm import hard_negatives, merkle, registry, token_files

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, grp string, digest string, idx string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS)


# ---- Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    i, text, lang, source, n = row
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def plain_tree(leaves):
    """The root, and each leaf's siblings."""
    siblings, at = [[] for _ in leaves], list(range(len(leaves)))
    while len(leaves) > 1:
        for k, i in enumerate(at):
            a = i - i % 3
            siblings[k] += [leaves[j] for j in range(a, min(a + 3, len(leaves))) if j != i]
        leaves, at = [h(*leaves[i : i + 3]) for i in range(0, len(leaves), 3)], [i // 3 for i in at]
    return leaves[0], siblings


def plain_manifest(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))):
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([plain_leaf(r) for r in groups[s]]) for s in order}
    root, upper = plain_tree([trees[s][0] for s in order])
    return sorted((str(r[0]), str(s), i, plain_leaf(r), "".join(trees[s][1][i] + upper[k]), trees[s][0], root) for k, s in enumerate(order) for i, r in enumerate(groups[s]))


def manifest_rows(df):
    return sorted((str(r["doc_id"]), str(r["source"]), r["place"], r["leaf"], r["siblings"], r["subroot"], r["root"]) for r in df.collect())


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_equals_plain_trees(spark, ws, levels):
    rng = random.Random(4)
    sources = ["a"] * 90 + ["b"] * 28 + ["ä", "Z", None, "", "𝄞"] + ["c"] * 3 + [None] * 2
    rows = [(i, rng.choice([None, "", "x\ny", "é€𝄞", "a\n\n"]), rng.choice(["en", None]), s, rng.choice([None, 7])) for i, s in enumerate(sources)]
    rows += [(None, "t", None, "a", None), (None, "s", None, "b", 1), (5, "same", "en", "a", 4), (5, "same", "en", "a", 4), (-3, "long " * 60_000, "en", "b", 4)]
    rng.shuffle(rows)
    df = docs(spark, rows).repartition(5)
    got = merkle.manifest(df, levels=levels, workspace=ws)
    assert manifest_rows(got) == plain_manifest(rows)
    for r in got.collect():
        assert merkle.fold(r["leaf"], r["siblings"], r["shape"]) == r["root"] == r["folded"]


def test_manifest_of_one_row_and_of_none(spark, ws):
    (r,) = merkle.manifest(docs(spark, [(1, None, None, None, None)]), workspace=ws).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded"] and r["siblings"] == ""
    assert merkle.manifest(docs(spark, []), workspace=ws).collect() == []


def test_manifest_hot_id_spreads_and_keeps_every_row(spark, ws):
    rows = [(7 if i % 3 else i, f"t{i % 5}", "en", "a", 1) for i in range(600)]
    assert manifest_rows(merkle.manifest(docs(spark, rows).repartition(7), levels=3, workspace=ws)) == plain_manifest(rows)


def test_manifest_tells_tampered_rows(spark, ws):
    rows = [(i, None if i % 7 == 0 else f"a{i}\nb" if i % 2 else f"a{i}", "en", "s", 3) for i in range(60)] + [(None, "a\nb", "en", "s", 3)]
    got = merkle.manifest(docs(spark, rows), claim=merkle.without_newlines(), workspace=ws).collect()
    for r in got:
        i = r["doc_id"]
        changed = i is not None and zlib.crc32(str(i).encode()) % 2 == 0 and i % 7 and i % 2
        assert (r["folded"] == r["root"]) == (not changed)


def test_manifest_reads_no_text_twice(spark, ws):
    """Texts become leaves in one scan of the JVM: no exchange, no Python before the staged leaves."""
    leaf = docs(spark, [(1, "a", "en", "s", 1)]).select(F.unhex(merkle.leaf_digest([F.col(c) for c in merkle.COLUMNS])))
    plan = leaf._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


# ---- token files


def plain_tokens(rows):
    coder = token_files.tokenizer(token_files.default_tokenizer_file())
    start, out = 0, []
    for i, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = coder.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((i, start, len(ids), ids))
        start += len(ids)
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    words = "the of naïve 東京 run-on 12345 <|endoftext|> \t \n\n don't 𝄞x".split(" ")
    rows = [(2 * i, " ".join(rng.choices(words, k=rng.randrange(60))), "en", "s", 1) for i in range(3000)]
    rows += [(1, None, None, None, None), (3, "", None, None, None), (None, "no id", None, None, None), (5, "word  two \n\n x " * 30_000, None, None, None), (7, "y" * 200_000, None, None, None)]
    rng.shuffle(rows)
    from pressline.llm.common import Workspace

    path = Workspace(spark, "tokens").sub("corpus")
    token_files.write(docs(spark, rows).repartition(4), path)
    return rows, path


def test_token_files_hold_every_document_in_order(spark, corpus):
    rows, path = corpus
    got = [(r["doc_id"], r["start"], r["n_tokens"], list(r["ids"])) for r in token_files.read(spark, path).orderBy("start").collect()]
    assert got == plain_tokens(rows)


def test_token_checksums(spark, corpus):
    rows, path = corpus
    want = {(i, s, n, zlib.crc32(np.array(ids, "<u4").tobytes())) for i, s, n, ids in plain_tokens(rows)}
    assert {tuple(r) for r in token_files.checksums(token_files.read(spark, path)).collect()} == want


def scanned_rows(df):
    """Rows that the ORC scan of the tokens gives, after stripes and strides were skipped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    text, nodes, found = "", [plan], []
    while nodes:
        node = nodes.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            nodes.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            nodes.append(node.plan())
            continue
        if node.nodeName().startswith("Scan orc"):
            text = node.simpleString(200)
            if "n_tokens" in text:
                found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return sum(found)


def test_lookup_prunes_strides_by_bounds_and_bloom_filters(spark, corpus):
    rows, path = corpus
    want = {r[0]: r for r in plain_tokens(rows)}
    some = token_files.lookup(spark, path, [400, 401, 3])
    assert {r["doc_id"]: tuple(r) for r in some.collect()} == {i: (*want[i][:3], want[i][3]) for i in (400, 3)}
    whole = scanned_rows(token_files.read(spark, path))
    assert whole == len(rows)
    # 4001 lies within the bounds of a stride, so only a Bloom filter can leave it out
    assert scanned_rows(token_files.lookup(spark, path, [4001])) <= whole // 4
    absent = [scanned_rows(token_files.lookup(spark, path, [i])) for i in range(2001, 2021, 2)]
    assert absent.count(0) >= 8, absent


def test_span_opens_the_parts_of_a_range(spark, corpus):
    rows, path = corpus
    every = plain_tokens(rows)
    total = sum(n for _, _, n, _ in every)
    for start, length in ((0, 1), (total // 2, 500), (total - 1, 10), (total, 5)):
        got = sorted((r["start"], r["doc_id"]) for r in token_files.span(spark, path, start, length).collect())
        assert got == [(s, i) for i, s, n, _ in every if s < start + length and s + n > start]


def test_token_files_of_nothing(spark, ws):
    token_files.write(docs(spark, []), ws.sub("none"))
    assert token_files.checksums(token_files.read(spark, ws.sub("none"))).collect() == []


def test_token_files_with_a_hot_id(spark, ws):
    rows = [(9, "same text", None, None, None)] * 300 + [(i, f"t {i}", None, None, None) for i in range(20)]
    token_files.write(docs(spark, rows).repartition(6), ws.sub("hot"))
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in token_files.read(spark, ws.sub("hot")).collect())
    assert got == sorted((s, i, n) for i, s, n, _ in plain_tokens(rows))


def test_tokens_of_pieces_are_those_of_the_text():
    coder = token_files.tokenizer(token_files.default_tokenizer_file())
    rng = random.Random(8)
    texts = ["".join(rng.choices(["a", "é", " ", "  ", "\n", "\t", "12", "'s", "!?", "東", " ", "　"], k=90_000)) for _ in range(4)] + ["", " ", "x" * 70_000 + " y"]
    texts += ["\n", " x", "x ", "x\n", "a\x1c b", "!\x1c!", "a\x0bb c", "a\xa0 b", "a\xa0  b", "don't  we'll \n x", "<|endoftext|> a <|endoftext|>", "\x1c"]
    texts += ["".join(rng.choices(["ab", "é", " ", " ", "\n", "12", "'s", "!?", "東", "x,", "\x1c"], k=rng.randrange(30))) for _ in range(3000)]
    by = token_files.Coder(coder)
    assert list(token_files.encode_texts(by, [])) == []
    assert [x.tolist() for x in token_files.encode_texts(by, ["ab " * (1 << 19)])] == [coder.encode("ab " * (1 << 19), add_special_tokens=False).ids]  # nothing is left for the end
    for _ in range(2):  # the second time from what is kept
        for text, ids in zip(texts, token_files.encode_texts(by, texts), strict=True):
            assert ids.tolist() == coder.encode(text, add_special_tokens=False).ids, text[:80]


def test_kept_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "PIECES", 500)
    monkeypatch.setattr(token_files, "BATCH_CHARS", 1000)
    coder = token_files.tokenizer(token_files.default_tokenizer_file())
    by = token_files.Coder(coder)
    texts = [" ".join(f"w{i * 7 + j}" for j in range(40)) for i in range(200)]
    for text, ids in zip(texts, token_files.encode_texts(by, texts), strict=True):
        assert ids.tolist() == coder.encode(text, add_special_tokens=False).ids
        assert by.n_pieces < 1500 and len(by.spaced) + len(by.exact) == by.n_pieces


class Counting:
    """A tokenizer or model that adds up the letters it is given."""

    def __init__(self, of, seen):
        self.of, self.seen = of, seen

    def _count(self, texts):
        self.seen.append(sum(c in "abcdefghij" for t in texts for c in t))

    def encode_batch_fast(self, texts, **options):
        self._count(texts)
        return self.of.encode_batch_fast(texts, **options)

    def tokenize(self, text):
        self._count([text])
        return self.of.tokenize(text)


def test_letters_are_encoded_once_whatever_stands_around_them():
    """A new word goes to the library once behind a space and once without, with no newline or marks around it."""
    coder = token_files.tokenizer(token_files.default_tokenizer_file())
    by, seen, rng = token_files.Coder(coder), [], random.Random(5)
    for name in ("tokenizer", "model", "merger"):
        if hasattr(by, name):
            setattr(by, name, Counting(getattr(by, name), seen))
    words = ["".join(rng.choices("abcdefghij", k=9)) for _ in range(400)]
    texts = [" ".join(f"{w} {w}, {w}*** {w}'s\n{w}\n{w}!?".split(" ")) for w in words]
    for _ in range(2):
        for text, ids in zip(texts, token_files.encode_texts(by, texts), strict=True):
            assert ids.tolist() == coder.encode(text, add_special_tokens=False).ids
    assert sum(seen) <= 2 * sum(map(len, words))


def test_parts_of_pieces_break_where_the_pattern_does():
    coder = token_files.tokenizer(token_files.default_tokenizer_file())
    rng = random.Random(12)
    atoms = ["a", "É", "ß", "ª", "\u024f", "\u0250", "ж", "東", "\u0301", "ǅ", "×", "´", "—", "…", "'", "'ll", "’s", "1", "½", "Ⅷ", "_", "!", "###", "<|endoftext|>", "😀", "\u200d", "\0", "\x7f", "\u180e", "\ufffd"]
    by = token_files.Coder(coder)
    for spaces in ([" "] * 10 + ["\n"] * 2, [" ", "  ", "\n", "\t", "\r\n", "\x1c", "\xa0"]):
        texts = ["".join(rng.choices([*atoms, *spaces], k=rng.randrange(25))) for _ in range(3000)]
        for text, ids in zip(texts, token_files.encode_texts(by, texts), strict=True):
            assert ids.tolist() == coder.encode(text, add_special_tokens=False).ids, text


def test_op12_starts_follow_each_other(spark):
    got = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in registry.op12_token_files(spark, "/root/testdata/sf0.001").collect())
    assert got[0][0] == 0 and all(a[0] + a[1] == b[0] and a[2] < b[2] for a, b in zip(got, got[1:], strict=False))


# ---- hard negatives

VECTORS = "vec_id bigint, embedding array<float>, label int, id string, q string, number int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], VECTORS)


def plain_negatives(rows, anchors, scale=256):
    fine = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    good = [(i, tuple(math.floor(scale * float(np.float32(x))) for x in v), c) for i, v, c in rows if i is not None and c is not None and fine(v)]
    out = []
    for i, v, c in sorted({r for r in good if anchors(r[0])}):
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, d) for j, w, d in good if len(w) == len(v)]
        for p, j, _ in sorted(s for s in scored if s[1] != i and s[2] == c)[:5]:
            inside = sorted(s for s in scored if s[2] != c and 30 * -p <= 100 * -s[0] <= 90 * -p)[:10]
            out += [(i, j, n + 1, k, -p, -s) for n, (s, k, _) in enumerate(inside)]
    return sorted(out)


def mined(df, ws, anchors="vec_id % 10 = 0", **more):
    return sorted(tuple(r) for r in hard_negatives.mine(df, df.filter(anchors), workspace=ws, **more).collect())


@pytest.mark.parametrize("seed", range(3))
def test_negatives_equal_brute_force(spark, ws, seed, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 40)  # several blocks of anchors
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (6, 5))
    rows = [(i, [float(np.float32(x)) for x in (rng.choice(centres) + rng.normal(0, [0.05, 0.3, 0][seed], 5)).round(2)], int(rng.integers(0, 4))) for i in range(900)]
    assert mined(vectors(spark, rows).repartition(3), ws) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_negatives_edge_cases(spark, ws):
    nan, inf = float("nan"), float("inf")
    rows = [(10 * i, [0.5, 0.25 * i], i % 2) for i in range(8)] + [(i, [0.3, 0.1 * (i % 7)], i % 3) for i in range(1, 60) if i % 10]
    rows += [(None, [1.0, 1.0], 0), (100, None, 1), (110, [1.0, None], 1), (120, [nan, 1.0], 1), (130, [inf, 0.0], 0), (140, [1.0, 1.0], None), (150, [], 1), (160, [1.0, 2.0, 3.0], 1), (170, [1.0, 2.0, 2.0], 1), (171, [1.0, 1.0, 1.0], 0), (180, [-1.0, -1.0], 5), (190, [1.0, 1.0], 5), (181, [0.0, 0.0], 5)]
    rows += [rows[9]] * 3 + [rows[3]] * 2 + [(20, [0.1, 0.1], 1)]
    assert mined(vectors(spark, rows), ws) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_negatives_of_nothing_and_of_one_label(spark, ws):
    assert mined(vectors(spark, []), ws) == []
    assert mined(vectors(spark, [(i, [1.0, float(i)], 3) for i in range(50)]), ws) == []
    assert mined(vectors(spark, [(0, [1.0], 3)]), ws) == []


def test_negatives_of_large_components_are_exact(spark, ws):
    rows = [(i, [float(2.0 ** (20 + i % 3)) + i * 8, 1.0], i % 2) for i in range(40)]
    assert mined(vectors(spark, rows), ws) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_trees_prune_clustered_rows(spark, ws):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (20, 16))
    place = rng.choice(20, 6000, p=[1 / 3] + [2 / 57] * 19)  # a third of the rows in one cluster
    rows = [(i, [float(x) for x in centres[c] + rng.normal(0, 0.05, 16)], int(rng.integers(0, 4))) for i, c in enumerate(place)]
    made = spark.sparkContext.accumulator(0)
    df = vectors(spark, rows)
    got = mined(df, ws, "vec_id % 100 = 0", leaf=16, counter=made)
    assert got == plain_negatives(rows, lambda i: i % 100 == 0)
    assert 0 < made.value < 0.5 * 2 * 60 * 6000


def test_tree_covers_its_rows():
    rng = np.random.default_rng(2)
    x = np.r_[rng.integers(-50, 50, (700, 4)), np.zeros((400, 4), int)]
    order, nodes = hard_negatives.build(x, np.arange(1100) % 5, leaf=16)
    assert sorted(order) == list(range(1100))
    for n in range(len(nodes["start"])):
        rows = x[order[nodes["start"][n] : nodes["end"][n]]]
        assert (np.sqrt(((rows - nodes["centre"][n]) ** 2).sum(1)) <= nodes["radius"][n]).all()
