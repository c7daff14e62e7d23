"""Hard-negative mining by branch and bound in ball trees.

For each anchor its positives are the best rows of its label, and for each positive the negatives
are the best rows of other labels whose score lies in a window relative to the positive's: near
enough to be hard, not so near as to be unlabelled positives.

Style: free (numpy inside tasks, DataFrame operations for the exchange).

*Method.*  Rows are dealt evenly over partitions and every partition builds ball trees of at most
TREE_ROWS rows: a node has a centre, a radius and the range of its labels.  An inner product with
any row of a node lies within ``anchor . centre`` plus or minus ``|anchor| * radius``, rounded
outwards.  Anchors go down a tree together, nearest child first; an anchor leaves a node whose
rows are all above or all below its windows, strictly beneath its current k-th best, or of
the wrong labels.  In a leaf the exact scores of the anchors that are left are made.  The k best of
a partition are its result, and a window over the partitions' results gives the answer.
Nothing is approximate, and the k-th best goes on from tree to tree of a partition.

*Scale.*  Anchors (a stated fraction of the rows) are taken in blocks of at most BLOCK rows and
BLOCK_BYTES, which is what is broadcast and what the driver sees at a time, with their positives;
each block reads the staged trees twice, once for positives and once for negatives.  The exchange
carries k entries for each anchor (and positive) and partition, numbers alone, never vectors.
A hot label is no group here: labels only decide within a node.  How much the bounds save depends
on the vectors: clustered ones save most pairs, directions drawn evenly in 64 dimensions
almost none, and then every anchor meets every row, in blocks, once for each search.

Defined cases: rows with a null id, label or vector, or with null or non-finite components take no
part; rows that repeat are candidates each, and anchors once; a row never is a positive of
an anchor of its own id; with fewer than the asked positives or negatives all are returned, with
none no row; a positive score below zero has an empty window; vectors of different lengths have no
score with each other; components and scores beyond 64 bits stop at their bounds; very long
vectors make smaller trees and blocks; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressline.llm.common import Workspace
from pressline.llm.topk import clipped, from_bytes, matrix, quantised, to_bytes, usable

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
TREE_ROWS, TREE_BYTES, LEAF = 8192, 8 << 20, 64
BLOCK, BLOCK_BYTES = 32_768, 32 << 20
TREES_A_TASK, TOGETHER, STRETCH = 64, 2048, 512
_EXACT, _LEAST, _MOST = 2**53, -(2**63), 2**63 - 1


def build(x: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """An order of the rows of x, and the nodes of a ball tree over it, parents first.

    A node's rows are start to end of the order; left and right are the numbers of its children, 0 for a leaf.
    """
    x = x.astype(np.float64)
    order = np.arange(len(x))
    start, end, left, right, centre, radius, low, high = [0], [len(x)], [0], [0], [], [], [], []
    node = 0
    while node < len(start):
        a, b = start[node], end[node]
        at = order[a:b]
        rows = x[at]
        middle = rows.mean(0)
        far = ((rows - middle) ** 2).sum(1)
        centre.append(middle)
        radius.append(np.sqrt(far.max()) * (1 + 1e-9) + 1e-6)
        low.append(labels[at].min())
        high.append(labels[at].max())
        if b - a > leaf and far.max() > 0:
            one = rows[far.argmax()]
            other = rows[((rows - one) ** 2).sum(1).argmax()]
            half = (b - a) // 2
            order[a:b] = at[np.argpartition(rows @ (other - one), half)]
            left[node], right[node] = len(start), len(start) + 1
            start += [a, a + half]
            end += [a + half, b]
            left += [0, 0]
            right += [0, 0]
        node += 1
    return order, {"start": np.array(start), "end": np.array(end), "left": np.array(left), "right": np.array(right), "centre": np.array(centre).reshape(len(start), x.shape[1]), "radius": np.array(radius), "low": np.array(low), "high": np.array(high)}


class Best:
    """The k best (score, id) of each of n lists, ties to smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, k), _LEAST, np.int64)
        self.ids = np.full((n, k), _MOST, np.int64)
        self.filled = np.zeros(n, np.int64)
        self.floor = np.full(n, _LEAST, np.int64)  # the k-th best score where there are k

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Offer entries to lists; gives the lists that may have changed."""
        full = self.filled[at] >= self.k
        better = ~full | (scores > self.floor[at]) | ((scores == self.floor[at]) & (ids < self.ids[at, -1]))
        at, scores, ids = at[better], scores[better], ids[better]
        touched = np.unique(at)
        if not len(touched):
            return touched
        held = np.arange(self.k) < self.filled[touched, None]
        at = np.concatenate([at, np.broadcast_to(touched[:, None], held.shape)[held]])
        scores = np.concatenate([scores, self.scores[touched][held]])
        ids = np.concatenate([ids, self.ids[touched][held]])
        order = np.lexsort((ids, ~scores, at))
        at, scores, ids = at[order], scores[order], ids[order]
        place = np.arange(len(at)) - np.searchsorted(at, touched)[np.searchsorted(touched, at)]
        keep = place < self.k
        self.scores[at[keep], place[keep]] = scores[keep]
        self.ids[at[keep], place[keep]] = ids[keep]
        self.filled[touched] = np.minimum(self.k, np.bincount(np.searchsorted(touched, at), minlength=len(touched)))
        self.floor[touched] = np.where(self.filled[touched] >= self.k, self.scores[touched, -1], _LEAST)
        return touched


class Anchors:
    """The anchors of one length in a block: vectors, ids, labels, and their numbers in the block."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, labels: np.ndarray, q: np.ndarray):
        self.numbers, self.ids, self.labels, self.q = numbers, ids, labels, q
        self.norms = np.sqrt((q.astype(np.float64) ** 2).sum(1)) * (1 + 1e-12)


class Positives:
    """What an anchor looks for among the rows of its own label."""

    same_label = True

    def __init__(self, anchors: Anchors, k: int):
        self.anchors, self.best = anchors, Best(len(anchors.ids), k)

    def reach(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score that an anchor still has use for."""
        return self.best.floor[at], np.full(len(at), _MOST)

    def take(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        a = self.anchors
        fine = (scores >= self.best.floor[at][:, None]) & (labels[None, :] == a.labels[at][:, None]) & (ids[None, :] != a.ids[at][:, None])
        row, column = np.nonzero(fine)
        self.best.add(at[row], scores[row, column], ids[column])


class Negatives:
    """What the (anchor, positive) pairs of an anchor look for among the rows of other labels.

    pairs: (first, last) pair of each anchor; low, high: the windows of the pairs.
    """

    same_label = False

    def __init__(self, anchors: Anchors, first: np.ndarray, last: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        self.anchors, self.first, self.last, self.low, self.high = anchors, first, last, low, high
        self.best = Best(len(low), k)
        self.owner = np.repeat(np.arange(len(first)), last - first)
        self.least, self.most = np.full(len(first), _MOST), np.full(len(first), _LEAST)
        np.minimum.at(self.least, self.owner, low)
        np.maximum.at(self.most, self.owner, high)

    def reach(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.least[at], self.most[at]

    def take(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        fine = (scores >= self.least[at][:, None]) & (scores <= self.most[at][:, None]) & (labels[None, :] != self.anchors.labels[at][:, None])
        row, column = np.nonzero(fine)
        if not len(row):
            return
        owner, score = at[row], scores[row, column]
        changed = []
        for place in range(int((self.last - self.first).max(initial=0))):
            pair = self.first[owner] + place
            there = np.flatnonzero(pair < self.last[owner])
            p, s = pair[there], score[there]
            inside = (s >= self.low[p]) & (s <= self.high[p])
            changed.append(self.best.add(p[inside], s[inside], ids[column[there[inside]]]))
        owners = np.unique(self.owner[np.concatenate(changed)])
        if len(owners):  # their windows begin at their k-th best now
            pairs = np.flatnonzero(np.isin(self.owner, owners))
            need = np.maximum(self.low[pairs], self.best.floor[pairs])
            self.least[owners] = _MOST
            np.minimum.at(self.least, self.owner[pairs], need)


def search(tree: dict, wanted, counter=None) -> None:
    """Let all anchors of ``wanted`` go down a tree."""
    a = wanted.anchors
    ids, labels, nodes = tree["ids"], tree["labels"], tree["nodes"]
    top = lambda x: max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    kind = np.float64 if top(a.q) * top(tree["x"]) * max(1, a.q.shape[1]) < _EXACT else object
    x = tree["x"].astype(kind)
    size = np.sqrt((nodes["centre"] ** 2).sum(1))
    for begin in range(0, len(a.ids), TOGETHER):
        here = slice(begin, begin + TOGETHER)
        q, norm = a.q[here].astype(kind), a.norms[here]
        middle = a.q[here].astype(np.float64) @ nodes["centre"].T
        slack = norm[:, None] * (nodes["radius"] + 1e-9 * (size + nodes["radius"]))[None, :] + 1e-6
        above, below = middle + slack, middle - slack
        left = [(0, np.arange(len(q)))]
        while left:
            node, at = left.pop()
            low, high = nodes["low"][node], nodes["high"][node]
            mine = a.labels[begin + at]
            at = at[(mine >= low) & (mine <= high)] if wanted.same_label else at[(mine != low) | (mine != high)]
            least, most = wanted.reach(begin + at)
            at = at[(above[at, node] >= least) & (below[at, node] <= most)]
            if not len(at):
                continue
            one, two = nodes["left"][node], nodes["right"][node]
            if one:
                first, second = (one, two) if above[at, one].sum() >= above[at, two].sum() else (two, one)
                left += [(second, at), (first, at)]
                continue
            rows = slice(nodes["start"][node], nodes["end"][node])
            if counter is not None:
                counter.add(len(at) * (rows.stop - rows.start))
            for part in range(rows.start, rows.stop, STRETCH):  # equal rows make large leaves
                cut = slice(part, min(part + STRETCH, rows.stop))
                wanted.take(begin + at, clipped(q[at] @ x[cut].T), ids[cut], labels[cut])


_TREE = "dim bigint, ids binary, labels binary, vectors binary, kind string, nodes binary"
_INTS, _REALS = ("start", "end", "left", "right", "low", "high"), ("radius",)


def _pack(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, leaf: int) -> pa.RecordBatch:
    order, nodes = build(x, labels, leaf)
    raw, kind = to_bytes(x[order])
    parts = [nodes[c].astype(np.int64).tobytes() for c in _INTS] + [nodes[c].tobytes() for c in _REALS] + [nodes["centre"].tobytes()]
    values = [x.shape[1], ids[order].tobytes(), labels[order].tobytes(), raw, kind, b"".join(parts)]
    return pa.RecordBatch.from_arrays([pa.array([values[0]], pa.int64()), *(pa.array([v], pa.binary()) for v in values[1:4]), pa.array([kind]), pa.array([values[5]], pa.binary())], names=[f.split()[0] for f in _TREE.split(", ")])


def _unpack(r: dict) -> dict:
    dim, raw = r["dim"], r["nodes"]
    n = len(raw) // (8 * (len(_INTS) + len(_REALS) + dim))
    column = lambda i, kind: np.frombuffer(raw, kind, n, 8 * n * i)
    nodes = {c: column(i, np.int64) for i, c in enumerate(_INTS)} | {c: column(len(_INTS) + i, np.float64) for i, c in enumerate(_REALS)}
    nodes["centre"] = np.frombuffer(raw, np.float64, n * dim, 8 * n * (len(_INTS) + len(_REALS))).reshape(n, dim)
    ids = np.frombuffer(r["ids"], np.int64)
    return {"ids": ids, "labels": np.frombuffer(r["labels"], np.int64), "x": from_bytes(r["vectors"], r["kind"], dim, len(ids)), "nodes": nodes}


def plant(batches, leaf: int = LEAF):
    """Trees of the rows (id, label, q) of a partition, each of one length of vectors; what is held is bounded by one batch and TREE_ROWS."""
    held: dict[int, list] = {}
    rows: dict[int, int] = {}
    limit = lambda dim: max(1, min(TREE_ROWS, TREE_BYTES // max(1, 8 * dim)))

    def flush(dim: int):
        parts = held.pop(dim)
        rows.pop(dim)
        ids, labels, x = (np.concatenate(c) for c in zip(*parts, strict=True))
        for i in range(0, len(ids), limit(dim)):
            j = slice(i, i + limit(dim))
            yield _pack(ids[j], labels[j], x[j], leaf)

    for batch in batches:
        ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
        lengths = batch.column("q").value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == dim)
            held.setdefault(dim, []).append((ids[at], labels[at], matrix(batch.column("q").take(pa.array(at)), dim)))
            rows[dim] = rows.get(dim, 0) + len(at)
            if rows[dim] >= limit(dim):
                yield from flush(dim)
        while sum(n * max(1, d) * 8 for d, n in rows.items()) > 2 * TREE_BYTES:  # many lengths
            yield from flush(max(rows, key=lambda d: rows[d] * d))
    for dim in list(held):
        yield from flush(dim)


def _blocks(asked: DataFrame):
    """Anchors in bounded blocks: for each length its Anchors, numbered in the block."""
    n, values = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("q")), F.lit(0))).first()
    blocks = max(-(-n // BLOCK), -(-8 * values // BLOCK_BYTES))
    part = F.pmod(F.xxhash64("id", "label", "q"), F.lit(max(1, blocks)))
    for b in range(blocks):
        table = asked.filter(part == b).toArrow().combine_chunks()
        ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
        q = table.column("q").combine_chunks()
        q = q if isinstance(q, pa.Array) else pa.concat_arrays(q.chunks)
        lengths = q.value_lengths().to_numpy(zero_copy_only=False)
        yield b, {dim: Anchors(at, ids[at], labels[at], matrix(q.take(pa.array(at)), dim)) for dim in np.unique(lengths).tolist() for at in [np.flatnonzero(lengths == dim)]}


def windows(scores: list[int], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest n with low * score <= 100 * n <= high * score."""
    return np.array([-((-low * s) // 100) for s in scores], np.int64), np.array([high * s // 100 for s in scores], np.int64)


def mine(df: DataFrame, anchors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = 256, leaf: int = LEAF, workspace: Workspace, counter=None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives from df for each anchor and positive.

    low and high are the window's bounds in percent of the positive's score.  counter: an
    accumulator that gets the number of (anchor, row) pairs whose score was made.
    """
    ws, spark = workspace, workspace.spark
    sc = spark.sparkContext

    def clean(part: DataFrame) -> DataFrame:
        named = part.select(F.col(id_col).cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), F.col(vector_col).alias("v"))
        return named.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))).select("id", "label", quantised(F.col("v"), scale).alias("q"))

    asked = ws.stage(clean(anchors).distinct(), "anchors")
    tasks = max(sc.defaultParallelism, -(-df.count() // (TREES_A_TASK * TREE_ROWS)))
    trees = ws.stage(clean(df).repartition(tasks).mapInArrow(lambda batches: plant(batches, leaf), _TREE), "trees")

    def results(shared, build_wanted, schema):
        """Each partition's best entries: of its anchors in phase one, of its pairs in phase two."""

        def run(batches):
            wanted = {dim: build_wanted(dim, a) for dim, a in shared.value["anchors"].items()}
            for batch in batches:
                for r in batch.to_pylist():
                    if wanted.get(r["dim"]) is not None:
                        search(_unpack(r), wanted[r["dim"]], counter)
            for dim, w in wanted.items():
                if w is None:
                    continue
                row, column = np.nonzero(np.arange(w.best.k) < w.best.filled[:, None])
                names = w.anchors.numbers if w.same_label else shared.value["pairs"][dim]["pair"]
                yield pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(w.best.scores[row, column]), pa.array(w.best.ids[row, column])], names=[f.split()[0] for f in schema.split(", ")])

        return trees.mapInArrow(run, schema)

    done = None
    for b, block in _blocks(asked):
        first = sc.broadcast({"anchors": block})
        found = results(first, lambda dim, a: Positives(a, positives), "number bigint, score bigint, id bigint")
        order = Window.partitionBy("number").orderBy(F.col("score").desc(), "id")
        # at most ``positives`` rows for each anchor of the block
        best = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives).orderBy("number", "place").toArrow()
        number, score, positive = (best.column(c).to_numpy() for c in ("number", "score", "id"))
        lows, highs = windows(score.tolist(), low, high)
        some = lows <= highs
        pairs, ids = {}, np.empty(0, np.int64)
        for dim, a in block.items():
            at = np.flatnonzero(some & np.isin(number, a.numbers))
            begin, end = np.searchsorted(number[at], a.numbers), np.searchsorted(number[at], a.numbers, "right")
            if len(at):
                pairs[dim] = {"pair": at, "first": begin, "last": end, "low": lows[at], "high": highs[at]}
        if not pairs:
            continue
        ids = np.zeros(1 + max(int(a.numbers.max()) for a in block.values()), np.int64)
        for a in block.values():
            ids[a.numbers] = a.ids
        second = sc.broadcast({"anchors": block, "pairs": pairs})

        def pair_lists(dim, a, shared=second):
            p = shared.value["pairs"].get(dim)
            return p and Negatives(a, p["first"], p["last"], p["low"], p["high"], negatives)

        found = results(second, pair_lists, "pair bigint, negative_score bigint, negative_id bigint")
        order = Window.partitionBy("pair").orderBy(F.col("negative_score").desc(), "negative_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
        known = spark.createDataFrame(pa.table({"pair": pa.array(np.arange(len(number))), "anchor_id": pa.array(ids[number]), "positive_id": pa.array(positive), "positive_score": pa.array(score)}))
        ws.stage(ranked.join(known, "pair").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), f"mined/block={b}")
        first.destroy()
        second.destroy()
        done = True
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(ws.sub("mined")).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, label, q FROM v WHERE vec_id % 100 = 0) a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES})
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""
