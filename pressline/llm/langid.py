"""Language identification with error-correcting output codes.

Style: free (Arrow batches, numpy); no shuffle of texts.

Each language is a codeword of bits: all distinct ways to split the languages in two where
they are few, else random splits chosen for their least distance between codewords.  A binary
classifier per bit, a ridge regression on hashed byte n-grams (1 to 3 letters, square roots of
counts, unit length), predicts the bit.  Decoding picks the codeword with the least total
loss log(1 + exp(-4 * bit * value)), each bit weighed by how well it separates its training
rows; where the runner-up is about as near, the answer is flagged as ambiguous.  score is the
share of the nearest codeword in exp(-loss) over all codewords.

Training: a hash sample of about ``sample`` labelled documents of each language (whole texts)
and of about MAX_ROWS in all, at least the first of each label by its hash.  Every label is
learned, however many there are, up to MAX_ROWS: the documented bound on labelled rows is the only
one.  Of more labels than rows, a hash sample of about MAX_ROWS labels is learned from one
row each.  The executors turn rows into feature vectors; the driver gets at most about 2 * MAX_ROWS
vectors of DIMENSIONS floats (400 MB; half of that unless labels are nearly as many as rows)
and solves a system of at most DIMENSIONS unknowns (134 MB), whatever the number of languages.
Prediction uses every whole text and nothing but the text.

Defined cases: a null text and a text without any letter (an empty one too) give ``und`` with
score 0; so does every text if nothing was learned; one learned language is predicted for any
text with a letter, with score 1; very long texts are read whole; ties go to the first language
by name; repeated rows each give their row; null ids stay (and are not learned from by
``learning_part``); null labels are not learned from, and of rows that repeat id and label one (the least text); an empty table gives no model and no
rows; other columns are not read.
"""

from __future__ import annotations

import functools
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressline.llm.common import ship

DIMENSIONS = 4096
SAMPLE, MAX_ROWS = 400, 12_000
MAX_EXHAUSTIVE, RANDOM_BITS, MANY, MANY_BITS = 6, 48, 64, 96
RIDGE, AMBIGUOUS = 0.05, 0.1
TRIES, TRIES_OF_MANY, SIDE = 50, 2, 1024
DECODED = 1 << 22

_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(raw: bytes) -> bool:
    return bool(_ASCII_LETTER.search(raw)) or any(c.isalpha() for c in raw.decode("utf-8", "replace") if c > "\x7f")


def vector(raw: bytes) -> np.ndarray:
    """The unit feature vector of a text."""
    clean = b" ".join(raw.lower().translate(_LETTERS).split())
    b = np.frombuffer(b" " + clean + b" ", np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(263) + b[2:] if len(b) > 2 else two[:0]
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    grams = np.concatenate([(b + np.uint32(1)) * np.uint32(2654435769), (two + np.uint32(70_001)) * np.uint32(2246822519), (three + np.uint32(20_000_003)) * np.uint32(3266489917)]) >> shift
    x = np.sqrt(np.bincount(grams, minlength=DIMENSIONS)).astype(np.float32)
    return x / np.sqrt(x @ x)


@functools.lru_cache(maxsize=16)
def codewords(k: int) -> np.ndarray:
    """k codewords of +-1 bits as rows; no bit is constant, none is another's opposite."""
    if k < 2:
        return np.ones((k, 1))
    if k <= MAX_EXHAUSTIVE:
        splits = np.arange(1, 2 ** (k - 1))
        rest = np.array([[1 if s >> i & 1 else -1 for s in splits] for i in range(k - 1)])
        return np.vstack([-np.ones(len(splits)), rest])
    rng, best, least = np.random.default_rng(7), None, -1
    bits = RANDOM_BITS if k <= MANY else MANY_BITS
    for _ in range(TRIES if k <= SIDE else TRIES_OF_MANY):
        code = rng.choice([-1.0, 1.0], (k, bits))
        code[:, np.abs(code.sum(0)) == k] *= np.where(np.arange(k) % 2, 1, -1)[:, None]
        nearest = -bits
        for i in range(0, k, SIDE):  # a strip of the table of distances at a time
            agree = code[i : i + SIDE] @ code.T
            agree[np.arange(len(agree)), np.arange(i, i + len(agree))] = -bits
            nearest = max(nearest, agree.max())
        far = (bits - nearest) / 2
        if far > least:
            best, least = code, far
    return best


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # DIMENSIONS x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit


def fit(vectors: np.ndarray, languages: list[str]) -> Model:
    """Ridge regressions, one for each bit of the code; in the dual where there are fewer rows than dimensions."""
    names = sorted(set(languages))
    code = codewords(len(names))
    at = {n: i for i, n in enumerate(names)}
    y = code[[at[n] for n in languages]]
    share = np.bincount([at[n] for n in languages], minlength=len(names))
    mean = (code * (1 / len(names))).sum(0)  # as if all languages had as many rows
    w = np.sqrt(1 / share[[at[n] for n in languages]])[:, None]
    n, dim = vectors.shape
    centre = (vectors.T @ w[:, 0] ** 2) / (w**2).sum()
    parts = [slice(i, i + 1024) for i in range(0, n, 1024)]  # so that only a part is ever held in double precision
    scaled = lambda at: (vectors[at] - centre) * w[at]
    goal = (y - mean) * w
    if n <= dim:
        xc = scaled(slice(None))
        gram = xc @ xc.T
        gram[np.diag_indices(n)] += RIDGE * max(np.trace(gram) / n, 1e-9)
        weights = xc.T @ np.linalg.solve(gram, goal)
    else:
        gram, right = np.zeros((dim, dim)), np.zeros((dim, y.shape[1]))
        for at in parts:
            xc = scaled(at)
            gram += xc.T @ xc
            right += xc.T @ goal[at]
        gram[np.diag_indices(dim)] += RIDGE * max(np.trace(gram) / n, 1e-9)
        weights = np.linalg.solve(gram, right)
    bias = mean - centre @ weights
    margin = sum(((vectors[at] @ weights + bias) * y[at] * w[at] ** 2).sum(0) for at in parts) / (w**2).sum()
    return Model(names, weights.astype(np.float32), bias, np.clip(margin, 0.05, 1.0))


def decode(model: Model, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language numbers, scores and ambiguity of rows of bit values."""
    code = codewords(len(model.languages))
    one, other = (code > 0).T.astype(np.float64), (code <= 0).T.astype(np.float64)
    found = []
    step = max(1, DECODED // len(code))
    for i in range(0, len(values), step):
        v = values[i : i + step]
        loss = (np.logaddexp(0, -4 * v) * model.trust) @ one + (np.logaddexp(0, 4 * v) * model.trust) @ other
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        order = np.partition(p, p.shape[1] - 2, axis=1)[:, -2:] if p.shape[1] > 1 else np.c_[np.zeros(len(p)), p]
        found.append((loss.argmin(1), order[:, 1], order[:, 1] - order[:, 0] < AMBIGUOUS))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def learning_part(id_col: Column) -> Column:
    """True for ids that may be learned from; null ids are not learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def train(df: DataFrame, *, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE, max_rows: int = MAX_ROWS) -> Model | None:
    """A model from about ``sample`` rows of each label of df, ``max_rows`` in all; None if df has no labelled text with letters."""
    spark = df.sparkSession
    ship(spark)
    usable = df.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("binary").alias("raw"))
    uniform = lambda c, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    draw = uniform("id", 29)
    per_label = usable.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(draw).alias("first"))
    many = per_label.count()
    if not many:
        return None
    each = max(1, min(sample, max_rows // many))
    learned = per_label.filter(uniform("label", 31) < max_rows / many) if many > max_rows else per_label
    counts = learned.select("label", "n", "first").toArrow()  # about max_rows rows at most
    shares = spark.createDataFrame(counts).select(F.col("label").alias("l"), F.least(F.lit(1.0), each / F.col("n")).alias("share"), "first")

    def batches(it):
        for batch in it:
            rows = [(label.as_py(), raw.as_py()) for label, raw in zip(batch.column(0), batch.column(1), strict=True)]
            rows = [(label, vector(raw)) for label, raw in rows if has_letter(raw)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1].tobytes() for r in rows], pa.binary())], names=["label", "x"])

    drawn = usable.join(F.broadcast(shares), F.col("label") == F.col("l")).filter((draw < F.col("share")) | (draw == F.col("first")))
    drawn = drawn.groupBy("label", "id").agg(F.min("raw").alias("raw")).select("label", "raw")
    got = sorted(((r["label"], bytes(r["x"])) for r in drawn.mapInArrow(batches, "label string, x binary").collect()))
    if not got:
        return None
    return fit(np.frombuffer(b"".join(x for _, x in got), np.float32).reshape(len(got), DIMENSIONS), [label for label, _ in got])


def predict(df: DataFrame, model: Model | None, *, id_col: str, text_col: str) -> DataFrame:
    """id_col, lang_pred, score, ambiguous."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS x bits floats
    kind = df.schema[id_col].dataType.simpleString()

    def batches(it):
        m = shared.value
        for batch in it:
            n = batch.num_rows
            lang, score, vague = ["und"] * n, np.zeros(n), np.zeros(n, bool)
            at, rows = [], []
            for i, raw in enumerate(batch.column(1)):
                raw = raw.as_py()
                if m is not None and raw and has_letter(raw):
                    at.append(i)
                    rows.append(vector(raw) @ m.weights + m.bias)
            if at:
                best, p, unsure = decode(m, np.array(rows))
                score[at], vague[at] = p, unsure
                for i, b in zip(at, best, strict=True):
                    lang[i] = m.languages[b]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(vague, pa.bool_())], names=[id_col, "lang_pred", "score", "ambiguous"])

    return df.select(F.col(id_col), F.col(text_col).cast("binary").alias("raw")).mapInArrow(batches, f"`{id_col}` {kind}, lang_pred string, score double, ambiguous boolean")
