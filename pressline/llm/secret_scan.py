"""Secret scans: patterns for known shapes, and a token-efficiency test for the unknown ones.

Style: free (Arrow batches, Python's re and the tiktoken library); no shuffle, one text at a
time, whole texts.

The efficiency test: a candidate is a run of letters, digits and ``+/_=-`` that holds letters:
of at least MIN_MIXED characters if it mixes digits with letters or changes case inside, else of
at least MIN_PLAIN.  Text that people write packs into few tokens of a byte pair vocabulary; a
random string does not, so a candidate with at most ``max_ratio`` characters per token is a
secret of kind ``random``.  Excluded, as random looking but public: hexadecimal digests of the
usual lengths, UUIDs, numbers and dates, repetitions of a few characters, paths and identifiers
made of words of the vocabulary (see ``is_worded``), and whatever overlaps a pattern's span.

The bounds are measured, not guessed (README): MAX_RATIO is the least that loses at most 1% of
random strings of any usual alphabet from MIN_MIXED characters on; prose has candidates down to
2.3 characters a token at MIN_PLAIN, and below 2.2 among shorter words of one case, which
therefore don't count.

Time is linear in the text (spans are compared with patterns' by bisection).

Defined cases: a null text has no spans (mask keeps it null), nor has an empty one; very long
texts are read whole; ties (two kinds at one start) are ordered as KINDS; repeated rows each
give their row; null ids stay; an empty table gives an empty result; scan reads no other
columns, mask keeps them all; offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressline.llm import bpe
from pressline.llm.common import ship

KINDS = ("assign", "access", "hex", "random")
# The shapes of the known kinds and the least length of what each has to hold.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # whole runs, so the same matches as of shorter ones that are dropped
_NAMES = ("passw", "secret", "token", "api")  # what every match of _ASSIGN holds: looked for first, as that is fast
MIN_ASSIGN, MIN_ACCESS = 8, 16
MAX_RATIO, MIN_MIXED, MIN_PLAIN = 2.2, 16, 20
MIN_WITHIN = 16  # a short word beside a ruled line is none; base32 with its padding of up to six has 18
DIGEST_CHARS = (32, 40, 56, 64, 96, 128)

_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_MIXED},}}")
_SWITCH = re.compile("[a-z][A-Z]")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_HEXRUN = re.compile(r"(?:0x)?([0-9a-fA-F]+)")
_WORDS = re.compile(r"[A-Za-z][a-z]+|[A-Z]+|[0-9]+")


def is_known(text: str) -> bool:
    """Digests, UUIDs, numbers, and repetitions of up to four characters."""
    run = _HEXRUN.fullmatch(text)
    if run and len(run[1]) in DIGEST_CHARS:
        return True
    if _UUID.fullmatch(text) or not re.search(r"[A-Za-z]", text):
        return True
    return any(text == (text[:n] * (len(text) // n + 1))[: len(text)] for n in range(1, 5))


def is_worded(text: str, enc) -> bool:
    """Identifiers and paths: most characters are in words, parts that the vocabulary packs at three or more letters a token.

    Case does not count, as the vocabulary holds few words in capitals.
    """
    parts = _WORDS.findall(text)
    worded = sum(len(p) for p in parts if p[0].isalpha() and len(p) >= 3 * len(enc.encode_ordinary(" " + p.lower())))
    return worded >= 0.7 * sum(len(p) for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the pattern kinds, ordered by start, then kind."""
    low = text.lower()
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN] if any(map(low.__contains__, _NAMES)) else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def is_mixed(word: str) -> bool:
    """Digits among letters, or at least two changes from lower to upper case."""
    return bool(re.search("[0-9]", word) and re.search("[A-Za-z]", word)) or len(_SWITCH.findall(word)) > 1


def random_spans(text: str, enc, taken: list[tuple[int, int, int]], max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    """Spans of kind random that overlap none of ``taken`` (ordered by start)."""
    starts = [a for a, _, _ in taken]
    reach = list(accumulate((b for _, _, b in taken), max))  # the furthest end of the spans up to each
    found = []
    for m in _CANDIDATE.finditer(text):
        word = m[0].strip("=-_/+") or m[0]
        if len(word) < MIN_WITHIN or not (is_mixed(word) or len(m[0]) >= MIN_PLAIN):
            continue
        before = bisect_left(starts, m.end())
        if (before and reach[before - 1] > m.start()) or is_known(word):
            continue
        if len(word) <= max_ratio * len(enc.encode_ordinary(word)) and not is_worded(word, enc):
            found.append((m.start(), 3, m.end()))
    return found


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(df: DataFrame, id_col: str, text_col: str, *, rank_file: str | None = None, max_ratio: float = MAX_RATIO, with_text: bool = True) -> DataFrame:
    """id_col, spans (array of kind, start, end, ordered by start then kind) and, with_text, redacted (the text with each span masked)."""
    ship(df.sparkSession)
    rank_file, pattern = rank_file or bpe.default_rank_file(), bpe.default_pattern()
    kind = df.schema[id_col].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def batches(it):
        enc = bpe.encoding(rank_file, pattern)
        for batch in it:
            spans, texts = [], []
            for raw in batch.column(1):
                raw = raw.as_py()
                text = raw.decode("utf-8", "replace") if raw else ""
                base = base_spans(text)
                every = sorted(base + random_spans(text, enc, base, max_ratio))
                spans.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in every])
                if with_text:
                    texts.append(None if raw is None else redact(text, every))
            columns = [batch.column(0), pa.array(spans, pa.list_(item))] + ([pa.array(texts, pa.string())] if with_text else [])
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "spans", "redacted"][: len(columns)])

    schema = f"`{id_col}` {kind}, spans array<struct<kind:string,start:int,end:int>>" + (", redacted string" if with_text else "")
    return df.select(F.col(id_col), F.col(text_col).cast("binary").alias("__raw")).mapInArrow(batches, schema)


def mask(df: DataFrame, text_col: str, *, count_col: str | None = None, rank_file: str | None = None, max_ratio: float = MAX_RATIO) -> DataFrame:
    """df with every span of a secret in text_col replaced by a mark; count_col, if given, gets the new number of code points (null for a null text)."""
    ship(df.sparkSession)
    rank_file, pattern = rank_file or bpe.default_rank_file(), bpe.default_pattern()
    at = df.columns.index(text_col)
    n_at = df.columns.index(count_col) if count_col else None

    def batches(it):
        enc = bpe.encoding(rank_file, pattern)
        for batch in it:
            texts = []
            for raw in batch.column(at).cast(pa.binary()):
                raw = raw.as_py()
                text = None if raw is None else raw.decode("utf-8", "replace")
                if text:
                    base = base_spans(text)
                    text = redact(text, sorted(base + random_spans(text, enc, base, max_ratio)))
                texts.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            if n_at is not None:
                columns[n_at] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(columns[n_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(batches, df.schema)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with every stretch that spans cover replaced by the name of its first kind."""
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"[{KINDS[kind]} removed]"]
        at = end
    return "".join(out) + text[at:]


def digest(scanned: DataFrame, id_col: str) -> DataFrame:
    """Counts, the digest of the pattern spans and all spans as strings."""

    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    spans = F.col("spans")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        id_col,
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(line(F.filter(spans, lambda s: s["kind"] != "random")), 256).alias("base_sha256"),
        line(spans).alias("spans"),
        count("random").alias("n_random"),
    )
