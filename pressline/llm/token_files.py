"""Token ids of a corpus in ORC files that read in parallel and prune by metadata.

``write`` encodes every text with a byte-level BPE of the ``tokenizers`` library, appends an end id
and writes the ids in ascending order of the documents' ids.  Below the path lie

* ``tokens``: ORC, a row for each document: its id, n_tokens, ahead (ids before it in its part),
  part and ids.  Integers are run-length encoded by ORC; row indexes every STRIDE rows hold the
  bounds of each column, and Bloom filters tell which strides may hold a document's id.
* ``index``: ORC, a row for each part: its documents, tokens, first and last id, and start, the
  number of ids in all parts before it.

``read`` gives the documents with their start in the whole sequence of ids, each split of a file
taking the stripes that begin in it; ``lookup`` reads the documents of a few ids, for which ORC skips
stripes and strides by their bounds and Bloom filters; ``span`` reads the documents of a range of
the sequence, of whose parts the index tells which to open.

Style: free (Arrow batches and the tokenizers library).  Texts are range-partitioned and sorted by
id once, encoded where they lie and written from there; ids never move.  Starts come from
sums of a row for each part, so no document waits for another.

*Scale.*  Memory is bounded by one Arrow batch, some BATCH_CHARS characters in the tokenizer (longer
texts are cut at white space behind other characters, where no token of the pattern runs over), the
distinct pieces that a worker keeps, and one stripe.  A hot id (a third of the rows) spreads over partitions, as ties are ordered by
their place in the input.  A lost executor costs its parts alone.

Defined cases: a null text is empty and an empty text gives the end id alone; rows with a null id
come first; rows that repeat an id are documents each, in the order of the input; strings of
special tokens in a text are ordinary text; bytes that are not UTF-8 become U+FFFD; very long
texts are encoded whole; an empty table gives empty files and an empty result; other columns are
not read, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressline.llm.bpe import pieces
from pressline.llm.common import ship

END_ID = 0
STRIDE, STRIPE_BYTES, FALSE_POSITIVES = 1000, 32 << 20, 0.01
BATCH_CHARS, BATCH_TOKENS = 1 << 22, 1 << 20
#: Distinct pieces, and ids of pieces, that a worker keeps.
PIECES, KEPT_IDS = 500_000, 4_000_000
TOGETHER = 2048
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
_BLANK = re.compile(r"\s")
_LATIN = "A-Za-zªµºÀ-ÖØ-öø-\u024f"  # all letters below U+0250
#: What a name begins with, letters, and the rest, which may go on with a letter where it is _FAR.
_PARTS = f"^(?P<lead>[\t\n]?)(?P<letters>[{_LATIN}]*)(?P<rest>(?s:.*))$"
_FAR, _LETTERS = "^[^\\x00-\u024f]", f"^\t?[{_LATIN}]+$"
#: What shows that the white space of a text is more than single spaces and newlines.
_ODD_SPACES = ("  ", " \n", "\n ", "\n\n", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"))
#: An index of more parts than this is not broadcast.
MOST_PARTS = 1 << 18


def default_tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def tokenizer(name: str):
    """The tokenizer of a file, built once in a worker: at its path, or as shipped with the job."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(name if os.path.exists(name) else SparkFiles.get(os.path.basename(name)))
    found.encode_special_tokens = True
    return found


class Coder:
    """Ids of texts by a tokenizer of the library, which sees each distinct piece of a text once.

    A piece begins at a space or newline behind a character that is not white space, where no token
    of the pattern runs over; so the ids of a text are those of its pieces, one after the
    other.  Arrow splits a batch of texts and finds the places of its pieces.  A piece that is not kept yet is put together
    from up to three parts between which the pattern always breaks: a newline, letters and what follows
    them.  Pieces and parts are kept with their ids, up to some PIECES of them and KEPT_IDS ids; then those go
    that were used once.

    The name of a piece that begins with a space is what follows it; of one that begins with a newline, itself;
    of others, as the first of a text, a tab (which no other name begins with) and the piece.
    """

    def __init__(self, found):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = found
        self.merger = Tokenizer(found.model)  # of words in the model's alphabet, a line each
        self.merger.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        # the visible characters that stand for bytes: themselves, or the next ones from U+0100 on; newlines stay
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = np.setdiff1d(np.arange(256), shown)
        self.alphabet = np.arange(256, dtype="<u2")
        self.alphabet[hidden] = 256 + np.arange(len(hidden))
        self.alphabet[10] = 10
        vocabulary = found.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)  # a character stands for a byte
        self.clear()

    def clear(self) -> None:
        self.names = pa.array([], pa.string())
        self.flat = np.empty(1 << 16, np.int32)
        self.first, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = np.zeros(0, np.int64)
        self.n_pieces = self.n_ids = 0

    @property
    def exact(self) -> pa.Array:
        return self.names.filter(pc.starts_with(self.names, "\t"))

    @property
    def spaced(self) -> pa.Array:
        return self.names.filter(pc.invert(pc.starts_with(self.names, "\t")))

    def forget(self) -> None:
        """Keep the pieces that were used more than once, at most half of what fits; what use was made of them counts half from now on."""
        least = 2
        while True:
            keep = np.flatnonzero(self.used >= least)
            if 2 * len(keep) <= PIECES and 2 * self.length[keep].sum() <= KEPT_IDS:
                break
            least *= 2
        names, ids, lengths, used = self.names.take(pa.array(keep)), self._gather(keep), self.length[keep], self.used[keep] // 2
        self.clear()
        self._keep(names, ids, lengths)
        self.used = used

    def _keep(self, names: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Places of new pieces, whose ids follow each other."""
        while self.n_ids + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.n_pieces + len(lengths) > len(self.first):
            self.first, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.length))
        at = slice(self.n_pieces, self.n_pieces + len(lengths))
        self.flat[self.n_ids : self.n_ids + len(ids)] = ids
        self.length[at] = lengths
        self.first[at] = self.n_ids + np.cumsum(lengths) - lengths
        self.names = pa.concat_arrays([self.names, names])
        self.n_ids += len(ids)
        self.n_pieces = at.stop
        return np.arange(at.start, at.stop)

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of the pieces at some places, one after the other."""
        lengths = self.length[at]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.first[at] - (ends - lengths), lengths) + np.arange(ends[-1] if len(at) else 0)]

    def _alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some words and the number of each."""
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(lists), np.int32), np.array([len(x) for x in lists], np.int64)

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters, perhaps behind a space, one token of the pattern each: the model's part alone."""
        raw = np.frombuffer("\n".join(words).encode(), np.uint8)
        ids = np.array(self.merger.encode_batch_fast([self.alphabet[raw].tobytes().decode("utf-16-le")], add_special_tokens=False)[0].ids, np.int32)
        ends = np.r_[np.flatnonzero(raw == 10), len(raw)] - np.arange(len(words))
        return ids, np.diff(np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1, prepend=0)

    def _together(self, lead: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words without white space, each behind a space or newline, encoded as one text and told apart by their bytes."""
        ids = np.array(self.tokenizer.encode_batch_fast([lead + lead.join(words)], add_special_tokens=False)[0].ids, np.int32)
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        after = np.cumsum(self.bytes_of[ids])
        stops = np.searchsorted(after, ends)
        if len(ids) and (stops < len(after)).all() and (after[stops] == ends).all():
            return ids, np.diff(stops + 1, prepend=0)
        return self._alone([lead + w for w in words])

    def _parts(self, names: list[str]) -> np.ndarray:
        """Keep parts that are not letters: those behind a space, and those that begin as a text does."""
        at = np.empty(len(names), np.int64)
        kinds = np.array([0 if _BLANK.search(n, 1) or len(n) < 2 else 1 if n[0] == "\t" else 2 for n in names], np.int8)
        for kind, size in ((0, max(len(names), 1)), (1, TOGETHER), (2, TOGETHER)):
            here = np.flatnonzero(kinds == kind)
            for i in range(0, len(here), size):
                some = here[i : i + size]
                words = [names[j] for j in some]
                if kind == 0:
                    ids, lengths = self._alone([w[1:] if w[:1] == "\t" else " " + w for w in words])
                elif kind == 1:  # the newline before each is a token
                    ids, lengths = self._together("\n", [w[1:] for w in words])
                    ids, lengths = np.delete(ids, np.cumsum(lengths) - lengths), lengths - 1
                else:
                    ids, lengths = self._together(" ", words)
                at[some] = self._keep(pa.array(words, pa.string()), ids, lengths)
        return at

    def learn(self, names: pa.Array) -> np.ndarray:
        """The places of some pieces, all different, that are not kept yet."""
        lead, letters, rest = pc.extract_regex(names, _PARTS).flatten()
        blurred = pc.and_(pc.not_equal(letters, ""), pc.match_substring_regex(rest, _FAR))
        if pc.any(blurred).as_py():
            rest = pc.if_else(blurred, pc.binary_join_element_wise(letters, rest, ""), rest)
            letters = pc.if_else(blurred, "", letters)
        spaced = pc.equal(lead, "")
        whole = pc.and_(spaced, pc.equal(letters, ""))  # a space and no letter behind it: a part itself
        front = pc.if_else(pc.equal(lead, "\n"), "\t\n", "\t")
        middle = pc.if_else(whole, names, pc.if_else(spaced, letters, pc.binary_join_element_wise("\t", letters, "")))
        back = pc.if_else(whole, "\t", pc.binary_join_element_wise("\t", rest, ""))
        parts = pa.concat_arrays([front, middle, back]).dictionary_encode()
        of = parts.indices.to_numpy().reshape(3, -1).T
        parts = parts.dictionary
        place = self.places(parts)
        new = np.flatnonzero(place < 0)
        fresh = parts.take(pa.array(new))
        plain = pc.match_substring_regex(fresh, _LETTERS)
        words = fresh.filter(plain)
        if len(words):
            lines = [w[1:] if w[0] == "\t" else " " + w for w in words.to_numpy(zero_copy_only=False).tolist()]
            place[new[plain.to_numpy(zero_copy_only=False)]] = self._keep(words, *self._letters(lines))
        others = pc.invert(plain)
        place[new[others.to_numpy(zero_copy_only=False)]] = self._parts(fresh.filter(others).to_pylist())
        at = pc.index_in(names, value_set=parts).fill_null(-1).to_numpy()
        at = np.where(at < 0, -1, place[at])
        joined = np.flatnonzero(at < 0)
        of = place[of[joined]]
        at[joined] = self._keep(names.take(pa.array(joined)), self._gather(of.ravel()), self.length[of].sum(1))
        return at

    def places(self, names: pa.Array) -> np.ndarray:
        """Places of some pieces, -1 for those that are not kept."""
        return pc.index_in(names, value_set=self.names).fill_null(-1).to_numpy().astype(np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each of some texts (together some BATCH_CHARS characters)."""
        if not texts:
            return []
        together = "".join(texts)
        found = [c for c in _ODD_SPACES if c in together]
        odd = [any(c in text for c in found) for text in texts]
        order = sorted(range(len(texts)), key=odd.__getitem__)
        plain = pc.split_pattern(pa.array(["\t" + texts[i].replace("\n", " \n") for i in order if not odd[i]], pa.string()), " ")
        others = [_CUT.split(texts[i]) for i in order if odd[i]]
        names = pa.concat_arrays([plain.flatten(), pa.array(["\t" + p for x in others for p in x], pa.string())])
        if self.n_pieces > PIECES or self.n_ids > KEPT_IDS:
            self.forget()
        at = self.places(names)
        missing = at < 0
        if missing.any():
            new = names.filter(pa.array(missing)).dictionary_encode()
            at[missing] = self.learn(new.dictionary)[new.indices.to_numpy()]
        self.used = np.pad(self.used, (0, self.n_pieces - len(self.used))) + np.bincount(at, minlength=self.n_pieces)
        ids = self._gather(at)
        sizes = np.r_[pc.list_value_length(plain).to_numpy(), np.array([len(x) for x in others], np.int64)]
        ends = np.cumsum(self.length[at])[np.cumsum(sizes) - 1].tolist()
        out = [ids] * len(texts)
        for i, start, end in zip(order, [0, *ends], ends, strict=False):
            out[i] = ids[start:end]
        return out


@functools.lru_cache(maxsize=2)
def coder(name: str) -> Coder:
    return Coder(tokenizer(name))


def encode_texts(by: Coder, texts: list[str]):
    """The ids of each text as an array, in order; long texts in parts, many short ones together."""
    waiting: list[str] = []
    owners: list[int] = []
    held, size, done = {}, 0, 0

    def run():
        for owner, ids in zip(owners, by.encode(waiting), strict=True):
            held.setdefault(owner, []).append(ids)
        pa.default_memory_pool().release_unused()  # what finding places took

    for i, text in enumerate(texts):
        for part in pieces(text):
            waiting.append(part)
            owners.append(i)
            size += len(part)
            if size >= BATCH_CHARS:
                run()
                waiting, owners, size = [], [], 0
        while done < i and (not owners or owners[0] > done):
            yield np.concatenate(held.pop(done))
            done += 1
    run()
    for i in range(done, len(texts)):
        yield np.concatenate(held.pop(i))


def write(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str | None = None, end_id: int = END_ID) -> None:
    """Write the token files of df below path."""
    spark = df.sparkSession
    ship(spark)
    name = tokenizer_file or default_tokenizer_file()
    if not spark.sparkContext.master.startswith("local["):
        spark.sparkContext.addFile(name)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"part int, ahead bigint, id {kind}, n_tokens bigint, ids array<int>"

    def batches(it):
        by, part, ahead = coder(name), TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.int32)

        def flush(keys, lists):
            nonlocal ahead
            sizes = np.array([len(x) for x in lists], np.int64)
            offsets = np.r_[0, np.cumsum(sizes)]
            columns = [pa.array(np.full(len(lists), part, np.int32)), pa.array(ahead + offsets[:-1]), keys, pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate(lists)))]
            ahead += int(offsets[-1])
            return pa.RecordBatch.from_arrays(columns, names=["part", "ahead", "id", "n_tokens", "ids"])

        for batch in it:
            keys, lists, first, held = batch.column(0), [], 0, 0
            texts = [(raw.as_py() or b"").decode("utf-8", "replace") for raw in batch.column(1)]
            for i, ids in enumerate(encode_texts(by, texts)):
                lists.append(np.concatenate([ids, end]))
                held += len(ids) + 1
                if held >= BATCH_TOKENS:
                    yield flush(keys.slice(first, len(lists)), lists)
                    lists, first, held = [], i + 1, 0
            if lists:
                yield flush(keys.slice(first, len(lists)), lists)

    ordered = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("raw"), F.monotonically_increasing_id().alias("at"))
    ordered = ordered.repartitionByRange("id", "at").sortWithinPartitions("id", "at").select("id", "raw")
    options = {"orc.bloom.filter.columns": "id", "orc.bloom.filter.fpp": FALSE_POSITIVES, "orc.row.index.stride": STRIDE, "orc.stripe.size": STRIPE_BYTES, "compression": "lz4"}
    ordered.mapInArrow(batches, schema).write.mode("overwrite").options(**options).orc(f"{path}/tokens")

    tokens = spark.read.schema(schema).orc(f"{path}/tokens")
    parts = tokens.groupBy("part").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each file
    parts.withColumn("start", F.sum("tokens").over(before) - F.col("tokens")).coalesce(1).write.mode("overwrite").orc(f"{path}/index")


def index(spark: SparkSession, path: str) -> DataFrame:
    """part, docs, tokens, first_id, last_id, start."""
    return spark.read.orc(f"{path}/index")


def _placed(tokens: DataFrame, parts: DataFrame, id_col: str) -> DataFrame:
    few = parts.count() <= MOST_PARTS  # rows of some 50 bytes
    placed = tokens.join(F.broadcast(parts) if few else parts, "part")
    return placed.select(F.col("id").alias(id_col), (F.col("start") + F.col("ahead")).alias("start"), "n_tokens", "ids")


def read(spark: SparkSession, path: str, *, id_col: str = "doc_id") -> DataFrame:
    """id_col, start (ids of all documents before it), n_tokens (with the end id) and ids."""
    parts = index(spark, path).select("part", "start")
    return _placed(spark.read.orc(f"{path}/tokens"), parts, id_col)


def lookup(spark: SparkSession, path: str, ids: list, *, id_col: str = "doc_id") -> DataFrame:
    """The documents of a few ids, as read gives them: the ids reach the ORC reader."""
    held = F.col("id").isin(list(ids))
    parts = index(spark, path).select("part", "start")
    return _placed(spark.read.orc(f"{path}/tokens").filter(held), parts, id_col)


def span(spark: SparkSession, path: str, start: int, length: int, *, id_col: str = "doc_id") -> DataFrame:
    """The documents that hold ids start to start + length of the whole sequence, as read gives them.

    The parts are found in the index (a row for each file; those of the range reach the driver).
    """
    end = start + length
    parts = index(spark, path).filter((F.col("start") < end) & (F.col("start") + F.col("tokens") > start)).select("part", "start")
    numbers = [r["part"] for r in parts.collect()]
    tokens = spark.read.orc(f"{path}/tokens").filter(F.col("part").isin(numbers))
    found = _placed(tokens, parts, id_col)
    return found.filter((F.col("start") < end) & (F.col("start") + F.col("n_tokens") > start))


def checksums(tokens: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """tokens (as read gives them) with ids_crc32, the crc32 of the ids as little-endian unsigned 32-bit integers, for ids."""
    kind = tokens.schema[id_col].dataType.simpleString()

    def batches(it):
        for batch in it:
            lists = batch.column(3)
            sums = [zlib.crc32(x.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return tokens.select(id_col, "start", "n_tokens", "ids").mapInArrow(batches, f"`{id_col}` {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
