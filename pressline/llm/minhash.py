"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

Style: free for the sketches (Arrow batches, numpy), DataFrame operations for the rest.

*Sketch.*  Rounds of hashed bin placement: in round i < t each shingle is thrown into one of t
bins with the value (i, hash); in round t + j all go into bin j.  A bin keeps its smallest
value, so earlier rounds win and throwing stops once all bins are full, after about t ln t
throws; the last t rounds guarantee that every coordinate fills.  The share of equal
coordinates of two sketches estimates the similarity with concentration as of independent
hashing.

*Plan.*  Documents with the same shingle set are one class, stood for by its smallest id.
Bands of the representatives' sketches give buckets.  Nowhere are all pairs of a bucket made:
in each round a bucket offers one or a few pivots, its members are compared with the pivots
alone, confirmed links join components, a pivot leaves its bucket once it has met all the
others, and a bucket ends when its members are in one component.  As a bucket ends in no other
way, each pair of a bucket is either compared, excluded by an exact bound or already
connected: no link is lost to a large bucket.  The bound comes from a bucket's first pivot P:
for members X and Y compared with it, |X & Y| <= min(|X & P|, |Y & P|) + |(X - P) & (Y - P)|,
and the differences from P are short where P is near to most.  Links are confirmed on full sets.  Components come from hooking to the smallest
neighbour and pointer jumping.

*Scale.*  Sets are made again from the text for bucket members only, and staged.  Every hot key
(a digest of many copies, a bucket of many near copies, a pivot with many partners) is either
pre-aggregated or the large side of a join with a staged table, which adaptive execution splits.
With t = 240 and 40 bands of 6, a pair at the threshold itself is missed with a probability
of 5e-6.

Defined cases: no words or null text: an empty set, linked with nothing; a null id: its own
component (null), kept; rows that repeat an id are one document, with the links of each of
its texts; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressline.llm.common import Sieve, WordHash, Workspace, mix64, ship, window_hashes

BANDS, ROWS = 40, 6
COORDINATES = BANDS * ROWS
SHINGLE = 5
JUMPS = 3
_BIN_BITS, _ROUND_BITS = np.uint64(8), np.uint64(9)
_HASH_BITS = np.uint64(64 - 8 - 9)
_HASH_MASK = np.uint64((1 << 47) - 1)
_VALUE_MASK = np.uint64((1 << 56) - 1)
_SEEDS = mix64(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BAND_SEEDS = mix64(np.arange(7, 7 + BANDS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def shingles(raw: bytes | None, k: int, table: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text with A-Z in lower case."""
    words = raw.lower().split() if raw else []
    return np.unique(window_hashes(table.array(words), k)) if words else np.empty(0, np.uint64)


def sketch(hashes: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """t coordinates of a non-empty set; none stays empty."""
    out, full = np.zeros(t, np.uint64), np.zeros(t, bool)
    size, first = len(hashes), 0
    per = max(1, (3 * t) // size)
    while first < t and not full.all():
        rounds = np.arange(first, min(t, first + per), dtype=np.uint64)
        h = mix64(hashes[None, :] ^ _SEEDS[rounds][:, None])
        bins = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        keys = np.sort(((bins << np.uint64(56)) | (rounds[:, None] << _HASH_BITS) | (mix64(h) & _HASH_MASK)).ravel())
        at = (keys >> np.uint64(56)).astype(np.intp)
        lead = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        lead = lead[~full[at[lead]]]
        out[at[lead]] = keys[lead] & _VALUE_MASK
        full[at[lead]] = True
        first += per
        per = max(1, (3 * t) // size)
    for j in np.flatnonzero(~full):  # the guaranteed rounds: all elements go to one bin
        h = mix64(mix64(hashes ^ _SEEDS[t + j])) & _HASH_MASK
        out[j] = (np.uint64(t + j) << _HASH_BITS) | h.min()
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    acc = _BAND_SEEDS.copy()
    for column in coordinates.reshape(BANDS, ROWS).T:
        acc = mix64(acc ^ column)
    return acc.view(np.int64)


def features(df: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """id, n (set size), d1 and d2 (128-bit digest of the set), bands."""
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def batches(it):
        table = WordHash()
        for batch in it:
            sizes, d1, d2, flat = [], [], [], []
            for raw in batch.column(1):
                s = shingles(raw.as_py(), k, table)
                sizes.append(len(s))
                d = xxhash.xxh3_128_digest(s.tobytes())
                d1.append(int.from_bytes(d[:8], "little", signed=True))
                d2.append(int.from_bytes(d[8:], "little", signed=True))
                flat.append(band_keys(sketch(s)) if len(s) else np.empty(0, np.int64))
            offsets = np.r_[0, np.cumsum([len(x) for x in flat])].astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *flat])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), bands], names=["id", "n", "d1", "d2", "bands"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("raw")).mapInArrow(batches, f"id {kind}, n bigint, d1 bigint, d2 bigint, bands array<bigint>")


def shingle_sets(df: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """node and s, the full set of shingle hashes."""
    kind = df.schema[id_col].dataType.simpleString()

    def batches(it):
        table = WordHash()
        for batch in it:
            sets = [shingles(raw.as_py(), k, table).view(np.int64) for raw in batch.column(1)]
            offsets = np.r_[0, np.cumsum([len(x) for x in sets])].astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["node", "s"])

    return df.select(F.col(id_col).alias("node"), F.col(text_col).cast("binary").alias("raw")).mapInArrow(batches, f"node {kind}, s array<bigint>")


def components(ws: Workspace, edges: DataFrame, name: str) -> DataFrame | None:
    """node, root (the smallest node that edges (u, v) reach), for each node of an edge; None without edges."""
    edges = ws.stage(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{name}-e0")
    whole, level = None, 0
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = ws.stage(both.groupBy("u").agg(F.min("v").alias("p")).select(F.col("u").alias("node"), F.least("u", "p").alias("root")), f"{name}-p{level}-0")
        for jump in range(1, 64):  # each round of three makes the paths an eighth as long
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("top"))
            moved = parent
            for _ in range(JUMPS):
                moved = moved.join(up, "root").select("node", F.col("top").alias("root"))
            moved = moved.join(up, "root").select("node", "root", (F.col("top") < F.col("root")).alias("short"))
            moved = ws.stage(moved, f"{name}-p{level}-{jump}")
            parent = moved.drop("short")
            if moved.filter("short").isEmpty():
                break
        if whole is None:
            whole = parent
        else:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("top"))
            whole = ws.stage(whole.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")), f"{name}-w{level}")
        level += 1
        u, v = parent.toDF("u", "ru"), parent.toDF("v", "rv")
        nxt = edges.join(u, "u").join(v, "v").filter("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))
        edges = ws.stage(nxt.distinct(), f"{name}-e{level}")
    return whole


def compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) with linked (similarity of at least percent / 100) and own (the shingles of a that b has not)."""
    one, other = sets.toDF("a", "sa"), sets.toDF("b", "sb")
    both = pairs.join(one, "a").join(other, "b").withColumn("own", F.array_except("sa", "sb"))
    common = F.size("sa") - F.size("own")
    linked = 100 * common >= percent * (F.size("own") + F.size("sb"))
    return both.select("a", "b", linked.alias("linked"), "own")


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = 80, workspace: Workspace) -> DataFrame:
    """One row per row of df: id_col, n_shingles, component_id, kept."""
    ws = workspace
    feats = ws.stage(features(df, id_col, text_col, shingle), "features")
    copies = feats.filter("n > 0 AND id IS NOT NULL").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    copies = ws.stage(copies, "copies")

    lone = feats.filter("n > 0 AND id IS NOT NULL").select("id", "n", "d1", "d2", "bands").join(copies, ["d1", "d2"], "left").filter("rep IS NULL OR rep = id")
    rows = ws.stage(lone.select(F.explode("bands").alias("key"), F.col("id").alias("node"), F.col("n").cast("int").alias("n")), "bands")
    full = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    active = ws.stage(rows.join(ws.stage(full, "buckets"), "key"), "members")
    ws.drop("bands")
    # what a node's buckets hold together: the member that most others are near to has the most
    nodes = ws.stage(active.groupBy("node").agg(F.sum("c").alias("weight")), "nodes")
    # texts that may be candidates join the others by id; a broadcast of ids would grow with the candidates
    likely = Sieve(ws, nodes.select("node"), "sieve").mark(df.select(id_col, text_col), id_col).filter("__held").select(id_col, text_col)
    mine = likely.hint("merge").join(nodes, F.col(id_col) == F.col("node"), "left_semi")
    sets = ws.stage(shingle_sets(mine, id_col, text_col, shingle), "sets")
    near = 100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")

    lead = F.max(F.struct("weight", "node", "n")).alias("p")
    weighed = ws.stage(active.drop("c").join(nodes, "node"), "weighed")
    pivots = ws.stage(weighed.groupBy("key").agg(lead).select("key", F.col("p.node").alias("pivot"), F.col("p.n").alias("pn")), "pivots-0")
    met = ws.stage(weighed.drop("weight").join(pivots, "key").filter("node <> pivot"), "met-0")
    first = ws.stage(compare(ws.stage(met.filter(near).select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), "pairs-0"), sets, percent), "first")
    labels = components(ws, first.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v")), "cc-0")
    own = first.select(F.col("a").alias("node"), F.col("b").alias("pivot"), "own")
    rest = met.select("key", "node", "n", "pivot")
    # a bucket of two is done; those that are one component with their pivot too
    rest = rest.withColumn("root", F.col("node")) if labels is None else rest.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rest = ws.stage(rest, "rest-0")
    step = 0
    while True:
        mixed = rest.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
        mixed = ws.stage(mixed, f"mixed-{step}")
        if mixed.isEmpty():
            break
        rest = rest.join(mixed, "key")
        if step == 0:
            rest = rest.join(own, ["node", "pivot"], "left").drop("pivot")
        rest = ws.stage(rest, f"mixed-rest-{step}")
        step += 1
        # the latest roots come first: a large component tends to have the smallest root, so stragglers meet all of it
        way = F.pmod(F.xxhash64("node", F.lit(step)), F.lit(4 ** min(step, 5)))
        last = F.max(F.struct("root", "node", "n", "own")).alias("p")
        pivots = rest.groupBy("key", way.alias("way")).agg(last).select("key", F.col("p.root").alias("proot"), F.col("p.node").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.own").alias("pown"))
        pivots = ws.stage(pivots, f"pivots-{step}")
        most = F.least(F.col("n") - F.size("own"), F.col("pn") - F.size("pown")) + F.size(F.array_intersect("own", "pown"))
        could = F.col("own").isNull() | F.col("pown").isNull() | (100 * most >= percent * (F.col("n") + F.col("pn") - most))
        pairs = rest.join(pivots, "key").filter((F.col("root") != F.col("proot")) & near & could).select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct()
        links = ws.stage(compare(ws.stage(pairs, f"pairs-{step}"), sets, percent).filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v")), f"links-{step}")
        if labels is not None:
            u, v = labels.toDF("u", "ru"), labels.toDF("v", "rv")
            links = links.join(u, "u", "left").join(v, "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
        fresh = components(ws, links, f"cc-{step}")
        if fresh is not None:
            if labels is None:
                labels = fresh
            else:
                up = fresh.toDF("root", "top")
                old = labels.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
                labels = ws.stage(old.union(fresh.join(labels, "node", "left_anti")), f"labels-{step}")
        rest = rest.drop("root").join(pivots.select("key", F.col("pivot").alias("node")), ["key", "node"], "left_anti")
        rest = rest.withColumn("root", F.col("node")) if labels is None else rest.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
        rest = ws.stage(rest.select("key", "node", "n", "own", "root"), f"rest-{step}")

    thin = feats.select("id", "n", "d1", "d2")
    placed = thin.join(copies, ["d1", "d2"], "left").select("id", "n", F.when(F.col("n") > 0, F.coalesce("rep", "id")).otherwise(F.col("id")).alias("rep"))
    if labels is not None:
        placed = ws.stage(placed, "placed").join(labels.toDF("rep", "root"), "rep", "left").select("id", "n", F.coalesce("root", "rep").alias("rep"))
    return placed.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.col("rep")).alias("component_id"), F.when(F.col("id").isNull(), F.lit(True)).otherwise(F.col("id") == F.col("rep")).alias("kept"))
