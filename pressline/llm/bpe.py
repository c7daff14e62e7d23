"""Byte-level BPE encoding and decoding with a local rank file.

Style: free (Arrow batches and the tiktoken library).  Every text is independent, so there is
no shuffle; memory is bounded by one Arrow batch and one piece of text.

Long texts are cut before any space or newline that follows a character which is not white
space.  The splitting pattern never lets a token run over such a place (white space can only
begin a token or fill it) and never looks back over it, so the ids of the pieces, one after
the other, are the ids of the text.

Defined cases: a null text counts as empty (no ids); bytes that are not UTF-8 become U+FFFD
before encoding; repeated rows each give their row; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressline.llm.common import ship

PIECE_CHARS = 1 << 16
_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def default_rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file; built once in a worker."""
    ranks = {}
    with open(rank_file, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS):
    """Parts of text, each of size or more characters up to the next safe boundary."""
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(enc: tiktoken.Encoding, text: str, size: int = PIECE_CHARS) -> list[int]:
    if len(text) <= size:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part in pieces(text, size):
        ids += enc.encode_ordinary(part)
    return ids


def encode_array(enc: tiktoken.Encoding, text: str, size: int = PIECE_CHARS) -> np.ndarray:
    """The ids of a text as an array."""
    parts = [enc.encode_to_numpy(p, allowed_special=set(), disallowed_special=()) for p in pieces(text, size)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def decode_ids(enc: tiktoken.Encoding, ids: list[int]) -> bytes:
    """The bytes of the ids: tokens may split a character, so only bytes are exact."""
    return enc.decode_bytes(ids)


def encode(df: DataFrame, id_col: str, text_col: str, *, rank_file: str | None = None, pattern: str | None = None, with_ids: bool = True, digests: bool = False) -> DataFrame:
    """id_col, n_tokens, then ids (array<int>) and, if asked for, ids_sha256 and decoded_sha256.

    decoded_sha256 is of the bytes that decoding the ids gives: equal to the text's own where
    the round trip is exact.
    """
    ship(df.sparkSession)
    rank_file, pattern = rank_file or default_rank_file(), pattern or default_pattern()
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint" + (", ids array<int>" if with_ids else "") + (", ids_sha256 string, decoded_sha256 string" if digests else "")

    def batches(it):
        enc = encoding(rank_file, pattern)
        names = [str(i) for i in range(enc.n_vocab)] if digests else []
        for batch in it:
            counts, all_ids, id_sha, out_sha = [], [], [], []
            for raw in batch.column(1):
                raw = raw.as_py()
                text = raw.decode("utf-8", "replace") if raw else ""
                ids = encode_text(enc, text) if digests else encode_array(enc, text)
                counts.append(len(ids))
                if with_ids:
                    all_ids.append(np.asarray(ids, np.int32))
                if digests:
                    id_sha.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                    out_sha.append(hashlib.sha256(decode_ids(enc, ids)).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64())]
            if with_ids:
                offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *all_ids]))))
            if digests:
                columns += [pa.array(id_sha, pa.string()), pa.array(out_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0].strip("`") for f in schema.split(", ")])

    return df.select(F.col(id_col), F.col(text_col).cast("binary").alias("__raw")).mapInArrow(batches, schema)


def decode(df: DataFrame, id_col: str, ids_col: str, *, rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """id_col and bytes (binary) of each list of ids; a null list gives no bytes (empty)."""
    ship(df.sparkSession)
    rank_file, pattern = rank_file or default_rank_file(), pattern or default_pattern()
    kind = df.schema[id_col].dataType.simpleString()

    def batches(it):
        enc = encoding(rank_file, pattern)
        for batch in it:
            out = [decode_ids(enc, ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "bytes"])

    return df.select(id_col, ids_col).mapInArrow(batches, f"`{id_col}` {kind}, bytes binary")
