"""Merkle manifest of a dataset by superblock reduction.

Every row is a leaf: the digest of its columns.  The leaves of a group, in ascending order, are
hashed in runs of ``fanout`` until one node, the group's subroot, remains; the subroots, in the
order of the groups, are hashed likewise to the root.  A row's proof is what a holder of the root
needs to check that row alone: on every level the siblings of its node and its place among them.

*Method.*  Leaves are numbered within their group, and numbers are bucketed by ``fanout ** levels``.
``applyInPandas`` collapses all these levels of a bucket at once to a bucket root; bucket roots are
the leaves of the next round, which is the same function on a fraction ``fanout ** -levels`` of the
rows, until every group is one node.  On the way back the proofs of the lower and the upper rounds
are concatenated.  Proofs are never stored for the leaves: a bucket keeps its digests, packed, and
its levels are hashed once more when the proof of the rounds above is there.

*Scale.*  A text is read once, in the JVM, and leaves as 32 bytes.  Leaves are numbered from a range
sort of the thin staged rows: the places within the sorted partitions, plus prefix sums of the
(group, partition) counts.  A hot group, or a hot id (input places break its ties), spreads over
partitions and buckets; a bucket has at most ``fanout ** levels`` rows (729, some 100 KB); there are
log(rows) / log(729) rounds, four for 10^11 leaves.  The driver reads nothing but whether a round
is the last.  Groups (sources) may be as many as rows.

Defined cases: a null column is ``-``, an empty text ``0:``; groups are ordered as UTF-8 text,
whatever their type, a null group is a group of its own and the first; rows with a null id are the first of their group; rows that tie in id are ordered by
their leaf, equal rows are leaves of their own; a lone leaf is its group's subroot and a lone
subroot the root, with an empty proof; very long texts are hashed whole; an empty table gives
an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressline.llm.common import Workspace

FANOUT, LEVELS = 3, 6
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(columns: list[Column]) -> Column:
    """Hex sha256 of the columns, each as its UTF-8 byte count, a colon and its value, or as a dash where null."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text)), 256)


def joined(run: list[str]) -> str:
    """The node above a run of nodes, all as hex."""
    return hashlib.sha256("".join(run).encode()).hexdigest()


def height(n: int, fanout: int) -> int:
    """Levels above n leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // fanout), h + 1
    return h


def collapse(leaves: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The given number of levels above the leaves of a bucket, the leaves themselves first."""
    out = [leaves]
    for _ in range(levels):
        out.append([joined(out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def path(levels: list[list[str]], at: int, fanout: int) -> tuple[str, bytes]:
    """Siblings of leaf ``at`` from level to level, and for each level two bytes: its place in the run and the run's length."""
    siblings, shape = [], bytearray()
    for nodes in levels[:-1]:
        start = at - at % fanout
        run = nodes[start : start + fanout]
        shape += bytes((at - start, len(run)))
        siblings += run[: at - start] + run[at - start + 1 :]
        at //= fanout
    return "".join(siblings), bytes(shape)


def fold(leaf: str, siblings: str, shape: bytes) -> str:
    """The root that a leaf has by its proof."""
    node, read = leaf, 0
    for place, length in zip(shape[::2], shape[1::2], strict=True):
        before, after = read + 64 * place, read + 64 * (length - 1)
        node = hashlib.sha256((siblings[read:before] + node + siblings[before:after]).encode()).hexdigest()
        read = after
    return node


def _split(packed: bytes) -> list[str]:
    text = packed.hex()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def numbered(df: DataFrame, workspace: Workspace, name: str) -> DataFrame:
    """Staged rows (grp, id, digest, ..) with idx, their number in their group by (id, digest), and n, the group's size."""
    order = ["grp", "id", "digest", "__at"]
    dealt = df.withColumn("__at", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()  # the partition and the place in it
    placed = workspace.stage(dealt.withColumn("__place", place).withColumns({"__part": F.shiftright("__place", 33), "__row": F.col("__place").bitwiseAND((1 << 33) - 1)}).drop("__at", "__place"), f"{name}-placed")
    parts = placed.groupBy(F.col("grp").alias("g"), F.col("__part").alias("p")).agg(F.min("__row").alias("first"), F.count(F.lit(1)).alias("rows"))
    group = Window.partitionBy("g")
    ahead = F.sum("rows").over(group.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("rows")
    parts = workspace.stage(parts.select("g", "p", "first", ahead.alias("ahead"), F.sum("rows").over(group).alias("n")), f"{name}-parts")
    both = placed.join(parts, (F.col("__part") == F.col("p")) & F.col("grp").eqNullSafe(F.col("g")))
    return both.withColumn("idx", F.col("ahead") + F.col("__row") - F.col("first")).drop("g", "p", "first", "ahead", "__part", "__row")


def _packed(nodes: DataFrame, levels: int, fanout: int) -> DataFrame:
    """Buckets of nodes (grp, idx, n, id, digest, claim): their digests packed in order, and their root."""
    size = fanout**levels
    schema = "grp string, bucket bigint, n bigint, ids array<string>, digests binary, claims binary, root binary"

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        n = int(rows["n"].iloc[0])
        leaves = _split(b"".join(rows["digest"]))
        root = collapse(leaves, min(levels, height(n, fanout)), fanout)[-1][0]
        return pd.DataFrame({"grp": [rows["grp"].iloc[0]], "bucket": [rows["bucket"].iloc[0]], "n": [n], "ids": [rows["id"].tolist()], "digests": [b"".join(rows["digest"])], "claims": [b"".join(x for x in rows["claim"] if x is not None)], "root": [bytes.fromhex(root)]})

    return nodes.withColumn("bucket", F.floor(F.col("idx") / size).cast("bigint")).groupBy("grp", "bucket").applyInPandas(reduce, schema)


def _above(packed: DataFrame, levels: int, fanout: int, workspace: Workspace, name: str) -> DataFrame:
    """For each bucket (g, b): siblings and shape of the rounds above it, and the group's top node."""
    size = fanout**levels
    none = {"siblings": F.lit(""), "shape": F.lit(b"")}
    done = packed.filter(F.col("n") <= size).select(F.col("grp").alias("g"), F.col("bucket").alias("b"), *(v.alias(k) for k, v in none.items()), F.col("root").alias("top"))
    rest = packed.filter(F.col("n") > size)
    if rest.isEmpty():
        return done
    nodes = rest.select("grp", F.col("bucket").alias("idx"), F.ceil(F.col("n") / size).cast("bigint").alias("n"), F.lit(None).cast("string").alias("id"), F.col("root").alias("digest"), F.lit(None).cast("binary").alias("claim"))
    lower = workspace.stage(_packed(nodes, levels, fanout), f"{name}-1")
    paths = _paths(lower, _above(lower, levels, fanout, workspace, f"{name}-1"), levels, fanout)
    return done.unionByName(workspace.stage(paths.select(F.col("grp").alias("g"), F.col("idx").alias("b"), "siblings", "shape", "top"), f"{name}-paths"))


def _paths(packed: DataFrame, above: DataFrame, levels: int, fanout: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """A row (grp, idx, id, digest, folded, siblings, shape, top, extra ..) for each node of the buckets: lower and upper proofs, concatenated.

    folded: what the node's claim comes to by its proof; of rows without a claim their own digest.
    """
    size = fanout**levels
    both = packed.join(above, (F.col("bucket") == F.col("b")) & F.col("grp").eqNullSafe(F.col("g"))).drop("g", "b")
    schema = "grp string, idx bigint, id string, digest string, folded string, siblings string, shape binary, top binary" + "".join(f", {c} binary" for c in extra)

    def unpack(frames):
        for frame in frames:
            for r in frame.to_dict("records"):
                leaves = _split(r["digests"])
                claims = _split(r["claims"]) or leaves
                tree = collapse(leaves, min(levels, height(int(r["n"]), fanout)), fanout)
                out = []
                for at, leaf in enumerate(leaves):
                    siblings, shape = path(tree, at, fanout)
                    siblings, shape = siblings + r["siblings"], shape + r["shape"]
                    out.append((r["bucket"] * size + at, r["ids"][at], leaf, fold(claims[at], siblings, shape), siblings, shape))
                table = pd.DataFrame(out, columns=["idx", "id", "digest", "folded", "siblings", "shape"])
                table.insert(0, "grp", [r["grp"]] * len(out))
                for c in ("top", *extra):
                    table[c] = [r[c]] * len(out)
                yield table

    return both.mapInPandas(unpack, schema)


def manifest(df: DataFrame, *, id_col: str = "doc_id", group_col: str = "source", columns: tuple[str, ...] = COLUMNS, claim: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS, workspace: Workspace) -> DataFrame:
    """A row for each row of df: id_col, group_col, place (in its group), leaf, siblings, shape, subroot, root, folded.

    siblings are hex digests one after the other, shape has two bytes for each level (place in
    the run, length of the run): ``fold(leaf, siblings, shape)`` is the root.  claim: a hex digest
    that is held against the proof in place of the row's leaf; folded is what it comes to.
    """
    ws = workspace
    leaf = F.unhex(leaf_digest([F.col(c) for c in columns]))
    thin = df.select(F.col(group_col).cast("string").alias("grp"), F.col(id_col).alias("id"), leaf.alias("digest"), (F.lit(None).cast("binary") if claim is None else F.coalesce(F.unhex(claim), leaf)).alias("claim"))
    nodes = numbered(ws.stage(thin, "leaves"), ws, "leaves")
    packed = ws.stage(_packed(nodes.withColumn("id", F.col("id").cast("string")), levels, fanout), "buckets")
    above = ws.stage(_above(packed, levels, fanout, ws, "buckets"), "above")

    # the groups' subroots are the leaves of one more tree
    tops = above.filter("b = 0").select(F.lit("").alias("grp"), F.col("g").alias("id"), F.col("top").alias("digest"), F.lit(None).cast("binary").alias("claim"))
    groups = ws.stage(_packed(numbered(tops, ws, "groups").withColumn("id", F.col("id").cast("string")), levels, fanout), "group-buckets")
    upper = _paths(groups, _above(groups, levels, fanout, ws, "group-buckets"), levels, fanout)
    upper = ws.stage(upper.select(F.col("id").alias("u"), F.col("siblings").alias("more"), F.col("shape").alias("ends"), F.col("top").alias("root")), "upper")
    above = above.join(upper, F.col("g").eqNullSafe(F.col("u"))).select("g", "b", F.concat("siblings", "more").alias("siblings"), F.concat("shape", "ends").alias("shape"), "top", F.col("root").alias("whole"))

    rows = _paths(packed, above, levels, fanout, ("whole",))
    return rows.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), F.col("grp").cast(df.schema[group_col].dataType).alias(group_col), F.col("idx").alias("place"), F.col("digest").alias("leaf"), "siblings", "shape", F.lower(F.hex("top")).alias("subroot"), F.lower(F.hex("whole")).alias("root"), "folded")


def without_newlines(columns: tuple[str, ...] = COLUMNS, *, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The leaf of a row whose text has lost its newlines, where 2 divides the crc32 of the decimal id; else null."""
    even = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    return F.when(even, leaf_digest([F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == text_col else F.col(c) for c in columns]))


#: crc32 in SQL: bit by bit over the decimal id, lowest bits first.
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda i: CAST((ascii(c) >> i) & 1 AS BIGINT))))),
    lambda a, b: CASE WHEN xor(a, b) & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END))"""


def _leaf_sql(text: str) -> str:
    fields = [text if c == "text" else f"CAST({c} AS VARCHAR)" for c in COLUMNS]
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({f}) AS VARCHAR) || ':' || {f}, '-')" for f in fields) + ")"


ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
         CASE WHEN {_CRC} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} END AS tampered
  FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d),
n AS (SELECT 0 AS lv, source, idx, leaf AS h FROM k
  UNION ALL
  SELECT lv + 1, source, idx // {FANOUT}, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER (PARTITION BY source) AS c FROM n) WHERE c > 1 GROUP BY lv, source, idx // {FANOUT}),
top AS (SELECT source, max(lv) AS top FROM n GROUP BY source),
subs AS (SELECT n.source, n.lv AS top, n.h AS subroot, row_number() OVER (ORDER BY n.source NULLS FIRST) - 1 AS idx FROM n JOIN top t ON n.source IS NOT DISTINCT FROM t.source AND n.lv = t.top),
m AS (SELECT 0 AS lv, idx, subroot AS h FROM subs
  UNION ALL
  SELECT lv + 1, idx // {FANOUT}, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER () AS c FROM m) WHERE c > 1 GROUP BY lv, idx // {FANOUT}),
f AS (
  SELECT k.doc_id, k.source, k.leaf, 0 AS lv, k.idx, s.idx AS sidx, s.top, coalesce(k.tampered, k.leaf) AS h, '' AS siblings
  FROM k JOIN subs s ON k.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT f.doc_id, f.source, f.leaf, f.lv + 1, f.idx // {FANOUT}, f.sidx, f.top,
         sha256(string_agg(CASE WHEN x.idx = f.idx THEN f.h ELSE x.h END, '' ORDER BY x.idx)), f.siblings || coalesce(string_agg(x.h, '' ORDER BY x.idx) FILTER (WHERE x.idx <> f.idx), '')
  FROM f JOIN n x ON x.source IS NOT DISTINCT FROM f.source AND x.lv = f.lv AND x.idx // {FANOUT} = f.idx // {FANOUT}
  WHERE f.lv < f.top GROUP BY f.doc_id, f.source, f.leaf, f.lv, f.idx, f.sidx, f.top, f.h, f.siblings),
g AS (
  SELECT doc_id, source, leaf, 0 AS lv, sidx AS idx, h, siblings FROM f WHERE lv = top
  UNION ALL
  SELECT g.doc_id, g.source, g.leaf, g.lv + 1, g.idx // {FANOUT},
         sha256(string_agg(CASE WHEN x.idx = g.idx THEN g.h ELSE x.h END, '' ORDER BY x.idx)), g.siblings || coalesce(string_agg(x.h, '' ORDER BY x.idx) FILTER (WHERE x.idx <> g.idx), '')
  FROM g JOIN m x ON x.lv = g.lv AND x.idx // {FANOUT} = g.idx // {FANOUT}
  WHERE g.lv < (SELECT max(lv) FROM m) GROUP BY g.doc_id, g.source, g.leaf, g.lv, g.idx, g.h, g.siblings)
SELECT g.doc_id, g.leaf, s.subroot, r.h AS root, sha256(g.siblings) AS proof_sha256, g.h AS folded_root, g.h = r.h AS verified
FROM g JOIN subs s ON g.source IS NOT DISTINCT FROM s.source, (SELECT h FROM m WHERE lv = (SELECT max(lv) FROM m)) r
WHERE g.lv = (SELECT max(lv) FROM m)
"""
