"""Exact top-k search by a three-phase uniform threshold.

Style: free (numpy on packed blocks) for scores, DataFrame operations for the exchange.

An inner product is the sum of the partial scores of m slices of the dimensions, so a vector is
a row of m lists, and a candidate that reaches a cutoff has a partial score of at least
cutoff / m in some list.  Rows are grouped around pivots (fitted on a bounded sample; every row
has its pivot), and a group's pivot and radius of each slice bound its entries of each list.

1. *Gather.*  Each query visits the groups with the largest bounds until these hold more than k
   rows, and keeps their k best exact scores.  The k-th best is a safe cutoff: k candidates
   reach it.
2. *Collect.*  The cutoff goes with the query to those groups alone that were not visited and
   whose bounds allow it: one list at least at cutoff / m, and the sum at the cutoff.  In each
   block of such a group (whose own bounds are looked at first), the first list's partial
   scores are made; entries that can't reach cutoff / m in any list, or the cutoff with the
   rest at its bound, are left out.
3. *Resolve.*  For the sufficient entries that remain, the other partial scores are made;
   whatever falls short of the cutoff goes, and the k best of both phases, with ties to smaller
   ids, are the answer.

Nothing is approximate (bounds are rounded up), no pair is scored twice, and groups out of
reach are never read for a query.  How much that saves depends on the vectors: clustered ones
save most pairs; on directions drawn evenly in 64 dimensions no bound excludes anything, and
all pairs are scored once.

*Scale.*  Rows are never repeated: a block of at most about BLOCK rows of one group (a hot group
is split by hash of the id) meets chunks of at most about CHUNK queries that visit it.  Pivots
and radii, PIVOTS for each length of vectors, are all that is broadcast or read by the driver;
the sample has at most SAMPLE rows.  Integers are packed as small as they fit.

Defined cases: null vectors and vectors with null or non-finite components take no part, nor
do rows with a null id; every other row is a candidate, also one that repeats an id or a whole
row; queries are the distinct (id, vector) of the query rows, and rows of one id share a list;
vectors of different lengths have no score with each other, those of length zero score 0; with
fewer than k candidates all are returned; empty tables give an empty result; other columns are
not read; components and scores beyond 64 bits stop at their bounds.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressline.llm.common import Workspace

K, SLICES = 10, 2
PIVOTS, SAMPLE, ROUNDS = 1024, 16_384, 4
BLOCK, CHUNK = 4096, 1024
DENSE = 0.02
_EXACT = 2**53


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * component) as longs."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column of one length as rows."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def cuts_of(dim: int, slices: int) -> list[tuple[int, int]]:
    at = np.linspace(0, dim, slices + 1).astype(int)
    return list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def norms(x: np.ndarray, slices: int) -> np.ndarray:
    """Length of each row in each slice, rounded up."""
    x = x.astype(np.float64)
    return np.stack([np.sqrt((x[:, i:j] ** 2).sum(1)) * (1 + 1e-12) for i, j in cuts_of(x.shape[1], slices)], 1)


def to_bytes(x: np.ndarray) -> tuple[bytes, str]:
    """Integers in the smallest type that holds them."""
    top = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    kind = "i2" if top < 2**15 else "i4" if top < 2**31 else "i8"
    return np.ascontiguousarray(x, kind).tobytes(), kind


def from_bytes(raw: bytes, kind: str, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(n, dim)


def partial_scores(q: np.ndarray, c: np.ndarray, slices: int, which: slice = slice(None)) -> list[np.ndarray]:
    """Exact inner products of the rows of q and c, one matrix for each of the slices of the dimensions in ``which``."""
    top = lambda x: max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    kind = np.float64 if top(q) * top(c) * max(1, q.shape[1]) < _EXACT else object
    q, c = q.astype(kind), c.astype(kind)
    return [q[:, i:j] @ c[:, i:j].T if j > i else np.zeros((len(q), len(c)), kind) for i, j in cuts_of(q.shape[1], slices)[which]]


def clipped(x: np.ndarray) -> np.ndarray:
    """Exact scores as 64-bit integers; what is beyond stops at the bounds."""
    if x.dtype != object:
        return x.astype(np.int64)
    return np.array([max(-(2**63), min(2**63 - 1, int(v))) for v in x.ravel()], np.int64).reshape(x.shape)


def best(total: np.ndarray, valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest valid entries of each row, ties to the first columns."""
    n = total.shape[1]
    if not total.size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if max(abs(int(total.min())), abs(int(total.max()))) < 2**62 // n:
        key = total * n + np.arange(n - 1, -1, -1)  # no two entries of a row are equal
    else:  # places in the order of the row
        order = np.argsort(~total, axis=1, kind="stable")
        key = np.empty_like(total)
        np.put_along_axis(key, order, np.broadcast_to(np.arange(n, 0, -1), total.shape), axis=1)
    key[~valid] = -(2**63)
    few = min(k, n)
    columns = np.argpartition(key, n - few, axis=1)[:, n - few :]
    rows = np.repeat(np.arange(len(total)), few)
    columns = columns.ravel()
    fine = valid[rows, columns]
    return rows[fine], columns[fine]


def fit_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """At most n rows around which the sample is grouped: a few rounds of k-means from spread rows."""
    x = np.unique(sample.astype(np.float64), axis=0)
    n = min(n, len(x))
    p = x[np.linspace(0, len(x) - 1, n).astype(int)]
    for _ in range(ROUNDS):
        near = nearest(x, p)
        size = np.bincount(near, minlength=n)
        total = np.zeros_like(p)
        np.add.at(total, near, x)
        p = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], p)
    return p


def nearest(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Number of the nearest pivot of each row."""
    half = (p**2).sum(1) / 2
    return np.concatenate([np.empty(0, np.int64), *((half - x[i : i + 4096] @ p.T).argmin(1) for i in range(0, len(x), 4096))])


def bounds(q: np.ndarray, q_norms: np.ndarray, p: np.ndarray, radii: np.ndarray, slices: int) -> np.ndarray:
    """Upper bounds (slice, query, group) of the partial scores of queries with the rows of groups."""
    q = q.astype(np.float64)
    out = []
    for s, (i, j) in enumerate(cuts_of(q.shape[1], slices)):
        reach = q_norms[:, s : s + 1] * radii[None, :, s]
        middle = q[:, i:j] @ p[:, i:j].T
        size = q_norms[:, s : s + 1] * np.sqrt((p[:, i:j] ** 2).sum(1))[None, :]
        out.append(middle + reach + 1e-9 * (size + reach) + 1e-6)
    return np.stack(out)


def allowed(bound: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Can a (query, group) pair hold a score of the query's cutoff: some list at cutoff / m, and the sum at the cutoff?"""
    cut = cut.astype(np.float64)[:, None]
    cut = cut - 1e-9 * np.abs(cut)
    return (bound.max(0) * len(bound) >= cut) & (bound.sum(0) >= cut)


def resolve(q: np.ndarray, c: np.ndarray, qn: np.ndarray, cn: np.ndarray, has: np.ndarray, cut: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact scores, and which of them are of sufficient entries that reach their query's cutoff; the others may be unfinished.

    After the first list, entries stay for which some list may reach cutoff / m and the sum the
    cutoff; the rest of the lists is made for these alone where they are few.
    """
    head = partial_scores(q, c, slices, slice(0, 1))[0]
    near = head.astype(np.float64)
    most, whole = near.copy(), near.copy()
    for s in range(1, slices):
        reach = np.outer(qn[:, s], cn[:, s]) * (1 + 1e-9) + 1e-6
        np.maximum(most, reach, out=most)
        whole += reach
    need = np.where(has, cut.astype(np.float64) - 1e-9 * np.abs(cut.astype(np.float64)), -np.inf)[:, None]
    enough = (most * slices >= need) & (whole >= need)
    if enough.mean() > DENSE:
        total = clipped(sum(partial_scores(q, c, slices, slice(1, None)), head))
    else:
        total = np.zeros(head.shape, np.int64)
        for i in np.flatnonzero(enough.any(1)).tolist():
            at = np.flatnonzero(enough[i])
            rest = partial_scores(q[i : i + 1], c[at], slices, slice(1, None))
            total[i, at] = clipped(sum((p[0] for p in rest), head[i, at]))
    return total, enough & ((total >= cut[:, None]) | ~has[:, None])


class Groups:
    """The pivots of each length of vectors; what is broadcast."""

    def __init__(self, pivots: dict[int, np.ndarray]):
        self.pivots = pivots
        self.radii: dict[int, np.ndarray] = {}
        self.sizes: dict[int, np.ndarray] = {}

    def of(self, dim: int) -> np.ndarray:
        got = self.pivots.get(dim)
        return np.zeros((1, dim)) if got is None else got


def _by_length(batch: pa.RecordBatch, name: str):
    """Places and rows of a batch's list column for each length."""
    column = batch.column(name)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == dim)
        yield dim, at, matrix(column.take(pa.array(at)), dim)


def top_k(df: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = 1024, slices: int = SLICES, workspace: Workspace, counter=None) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of df for each row of queries but those with its own id.

    counter: an accumulator that gets the number of pairs of which any partial score was made.
    """
    ws, spark = workspace, workspace.spark
    sc = spark.sparkContext

    def clean(part: DataFrame) -> DataFrame:
        return part.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("q"))

    rows = ws.stage(clean(df), "rows")
    asked = ws.stage(clean(queries).distinct(), "asked")
    n_rows = rows.count()

    # pivots from a sample by hash of the id: at most SAMPLE rows reach the driver
    share = min(1.0, SAMPLE / max(1, 2 * n_rows))
    drawn = rows.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) <= int(share * (1 << 30))).limit(SAMPLE).toArrow()
    by_dim: dict[int, list] = {}
    for q in drawn.column("q").to_pylist():
        by_dim.setdefault(len(q), []).append(q)
    groups = Groups({d: fit_pivots(np.array(v, np.float64).reshape(len(v), d), min(PIVOTS, math.isqrt(n_rows) + 1)) for d, v in by_dim.items()})
    shared = sc.broadcast(groups)

    def assign(it):
        for batch in it:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for dim, at, x in _by_length(batch, "q"):
                p = shared.value.of(dim)
                group = nearest(x.astype(np.float64), p)
                far = norms(x - p[group], slices) if dim else np.zeros((len(at), slices))
                far = far * (1 + 1e-9) + 1e-6
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(np.full(len(at), dim)), pa.array(group), pa.FixedSizeListArray.from_arrays(pa.array(far.ravel()), slices).cast(pa.list_(pa.float64())), batch.column("q").take(pa.array(at))], names=["id", "dim", "grp", "far", "q"])

    placed = ws.stage(rows.mapInArrow(assign, "id bigint, dim bigint, grp bigint, far array<double>, q array<bigint>"), "placed")
    # a row for each pivot: bounded by PIVOTS for each length of vectors
    stats = placed.groupBy("dim", "grp").agg(F.count(F.lit(1)).alias("n"), *(F.max(F.get("far", s)).alias(f"r{s}") for s in range(slices))).collect()
    for r in stats:
        p = groups.of(r["dim"])
        radii = groups.radii.setdefault(r["dim"], np.zeros((len(p), slices)))
        radii[r["grp"]] = [r[f"r{s}"] for s in range(slices)]
        groups.sizes.setdefault(r["dim"], np.zeros(len(p), np.int64))[r["grp"]] = r["n"]
    known = sc.broadcast(groups)

    # blocks of the candidates: a hot group is split by hash of the id
    parts = spark.createDataFrame([(r["dim"], r["grp"], max(1, -(-r["n"] // BLOCK))) for r in stats], "dim bigint, grp bigint, parts bigint") if stats else spark.createDataFrame([], "dim bigint, grp bigint, parts bigint")
    parts = ws.stage(parts, "parts")
    keyed = placed.join(F.broadcast(parts), ["dim", "grp"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), "parts"))  # a row a pivot

    def pack(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        ids = table.column("id").to_numpy()
        x = matrix(table.column("q"), dim)
        order = np.argsort(ids, kind="stable")
        middle = x.mean(0)
        radii = norms(x - middle, slices).max(0) * (1 + 1e-9) + 1e-6
        raw, kind = to_bytes(x[order])
        first = lambda name: [table.column(name)[0].as_py()]
        return pa.table({"dim": [dim], "grp": first("grp"), "part": first("part"), "ids": [ids[order].tobytes()], "vectors": [raw], "kind": [kind], "middle": [middle.astype(np.float64).tobytes()], "radii": [radii.tobytes()]})

    blocks = ws.stage(keyed.select("dim", "grp", "part", "id", "q").groupBy("dim", "grp", "part").applyInArrow(pack, "dim bigint, grp bigint, part bigint, ids binary, vectors binary, kind string, middle binary, radii binary"), "blocks")

    def visits(phase: int):
        """Rows (query, group) of the groups that each query visits: in phase 1 those with the largest bounds, in phase 2 the others that its cutoff allows."""

        def run(it):
            g = known.value
            for batch in it:
                ids = batch.column("id").to_numpy(zero_copy_only=False)
                cut = batch.column("cut").to_numpy(zero_copy_only=False) if phase == 2 else None
                for dim, at, x in _by_length(batch, "q"):
                    if dim not in g.radii:
                        continue  # no candidate of this length
                    sizes = g.sizes[dim]
                    for start in range(0, len(at), 1024):
                        here = slice(start, start + 1024)
                        b = bounds(x[here], norms(x[here], slices), g.of(dim), g.radii[dim], slices)
                        order = np.argsort(-np.where(sizes > 0, b.sum(0), -np.inf), axis=1, kind="stable")
                        held = np.cumsum(sizes[order], axis=1)
                        # enough rows before this group: k and the query's own
                        first = np.zeros(order.shape, bool)
                        np.put_along_axis(first, order, (held - sizes[order]) <= k, axis=1)
                        first &= sizes > 0
                        take = first
                        if phase == 2:
                            some = cut[at[here]]
                            has = ~np.isnan(some.astype(np.float64))
                            take = ~first & (sizes > 0) & (allowed(b, np.where(has, some, 0)) | ~has[:, None])
                        q_at, grp = np.nonzero(take)
                        places = at[here][q_at]
                        columns = [pa.array(ids[places]), pa.array(np.full(len(places), dim)), pa.array(grp), batch.column("q").take(pa.array(places))]
                        if phase == 2:
                            columns.append(batch.column("cut").take(pa.array(places)))
                        yield pa.RecordBatch.from_arrays(columns, names=["id", "dim", "grp", "q", "cut"][: len(columns)])

        return run

    def score(phase: int):
        def run(it):
            for batch in it:
                for r in batch.to_pylist():
                    dim, cid, qid = r["dim"], np.frombuffer(r["ids"], np.int64), np.frombuffer(r["qids"], np.int64)
                    c, q = from_bytes(r["vectors"], r["kind"], dim, len(cid)), from_bytes(r["qvectors"], r["qkind"], dim, len(qid))
                    if phase == 1:
                        go = np.arange(len(qid))
                        total = clipped(sum(partial_scores(q, c, slices)))
                        valid = np.ones(total.shape, bool)
                    else:
                        has, cut = np.frombuffer(r["has"], bool), np.frombuffer(r["cuts"], np.int64)
                        qn, cn = norms(q, slices), norms(c, slices)
                        block = bounds(q, qn, np.frombuffer(r["middle"], np.float64)[None, :], np.frombuffer(r["radii"], np.float64)[None, :], slices)
                        go = np.flatnonzero(allowed(block, np.where(has, cut, 0))[:, 0] | ~has)
                        if not len(go):
                            continue
                        q, qn, has, cut = q[go], qn[go], has[go], cut[go]
                        total, valid = resolve(q, c, qn, cn, has, cut, slices)
                    made = total.size
                    valid &= cid[None, :] != qid[go][:, None]
                    row, column = best(total, valid, k)
                    if counter is not None:
                        counter.add(made)
                    yield pa.RecordBatch.from_arrays([pa.array(qid[go][row]), pa.array(cid[column]), pa.array(total[row, column])], names=["query_id", "vec_id", "score"])

        return run

    def chunk(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        raw, kind = to_bytes(matrix(table.column("q"), dim))
        out = {"dim": [dim], "grp": [table.column("grp")[0].as_py()], "qids": [table.column("id").to_numpy().tobytes()], "qvectors": [raw], "qkind": [kind]}
        if "cut" in table.column_names:
            cut = table.column("cut").combine_chunks()
            out |= {"cuts": [cut.fill_null(0).to_numpy().tobytes()], "has": [cut.is_valid().to_numpy(zero_copy_only=False).tobytes()]}
        return pa.table(out)

    def meet(visiting: DataFrame, phase: int) -> DataFrame:
        """Entries (query_id, vec_id, score) of the visits."""
        visiting = ws.stage(visiting, f"visits-{phase}")
        many = ws.stage(visiting.groupBy("dim", "grp").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks")).join(parts, ["dim", "grp"]), f"many-{phase}")  # a row a pivot
        dealt = visiting.join(F.broadcast(many.drop("parts")), ["dim", "grp"]).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(4)), "chunks")).drop("chunks")
        schema = "dim bigint, grp bigint, qids binary, qvectors binary, qkind string" + (", cuts binary, has binary" if phase == 2 else "")
        packed = dealt.groupBy("dim", "grp", "chunk").applyInArrow(chunk, schema)
        packed = packed.join(F.broadcast(many.drop("chunks")), ["dim", "grp"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        # queries, whose number of groups is not known beforehand, are not broadcast
        met = blocks.hint("merge").join(packed.withColumn("part", F.col("part").cast("long")), ["dim", "grp", "part"])
        return ws.stage(met.mapInArrow(score(phase), "query_id bigint, vec_id bigint, score bigint"), f"entries-{phase}")

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    first = meet(asked.mapInArrow(visits(1), "id bigint, dim bigint, grp bigint, q array<bigint>"), 1)
    kth = first.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).filter(F.col("place") == k).select(F.col("query_id").alias("id"), F.col("score").alias("cut"))
    again = asked.join(kth, "id", "left")
    second = meet(again.mapInArrow(visits(2), "id bigint, dim bigint, grp bigint, q array<bigint>, cut bigint"), 2)
    return first.union(second).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, q FROM v WHERE vec_id % 100 = 0) a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {K}
"""
