"""Token ids on disk: a static range asymmetric numeral system over shared frequency tables.

Layout of a store: `table` holds one frequency per token id, scaled to 2**SCALE over the whole corpus; `blocks`
holds independent blocks in order of shard and block number. A block codes whole documents with LANES
interleaved coders, so that one array step codes a symbol of every lane; it starts with the coders' states, keeps
their states again at every CHECKPOINT steps (from which decoding can start as well), and ends with a checksum.
Both tables are Parquet, so that any store Spark can reach will do.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftmark.llm.common import Scratch

U = np.uint64
SCALE = 18
LANES = 1024
CHECKPOINT = 128
BLOCK = 1 << 18
MAGIC = b"DMK1"
_LOW = U(1 << 31)
_HEAD = struct.Struct("<4sQIII")  # magic, symbols, lanes, checkpoint steps, words


#: Latin letters that NFC and lower case keep one letter each, with or without marks of punctuation behind them.
_LETTERS = "a-zA-ZÀ-ÖØ-öø-įı-ɏ"
_PLAIN = "^[%s]+[%s]*$" % (_LETTERS, re.escape(string.punctuation))
_LOWER = "".join(sorted({c.lower() for c in map(chr, range(0x41, 0x250)) if re.fullmatch(f"[{_LETTERS}]", c)}))
#: The settings under which words part at ASCII white space and a plain word is one stem and one run of marks: any
#: other tokenizer file encodes whole texts.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _word_rules(path: str) -> bool:
    """Is the file's tokenizer one whose plain words can be learnt by stem and marks?"""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    normal = (told.get("normalizer") or {}).get("normalizers", [])
    parts = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
    model = told.get("model") or {}
    return (
        [n["type"] for n in normal] == _NORMALIZERS
        and normal[1]["pattern"] == {"Regex": r"\s+"}
        and normal[1]["content"] == " "
        and [p["type"] for p in parts] == ["Split", "ByteLevel"]
        and parts[0]["pattern"] == {"Regex": _SPLIT}
        and parts[0]["invert"]
        and not parts[1]["add_prefix_space"]
        and not parts[1]["use_regex"]
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and told.get("post_processor") is None
        and not any(t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) for t in told.get("added_tokens", []))
    )


def _lists(parts: list[list[int]], kind: str) -> pa.ListArray:
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    ids = np.fromiter(itertools.chain.from_iterable(parts), np.dtype(kind), int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))


class WordEncoder:
    """ids of texts by the tokenizers library, a batch of texts at a time.

    Under _word_rules no piece crosses ASCII white space, so each distinct word of a batch is encoded once: plain words
    by the library's BPE model, once for each distinct stem and run of marks, others by the whole tokenizer. Nothing is
    kept from batch to batch.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        size = max(self.tokenizer.get_vocab().values(), default=0) + 1
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.by_word = _word_rules(path)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {ord(c): level.pre_tokenize_str(c)[0][0] for c in _LOWER if not c.isascii()}

    def _each(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, parts: list[str]) -> list[list[int]]:
        """ids of stems and runs of marks, in lower case: one word each to the model."""
        model = self.tokenizer.model.tokenize
        return [[t.id for t in model(p if p.isascii() else p.translate(self.bytes))] if p else [] for p in parts]

    def _words(self, words: pa.Array, end: int | None) -> pa.ListArray:
        """The ids of each distinct word, and as a last list the end id."""
        plain = pc.match_substring_regex(words, _PLAIN)
        low = pc.utf8_lower(words.filter(plain))
        stem = pc.utf8_rtrim(low, string.punctuation).dictionary_encode()
        tail = pc.utf8_ltrim(low, _LOWER).dictionary_encode()
        rest = words.filter(pc.invert(plain)).to_pylist()
        stems, tails = stem.dictionary.to_pylist(), tail.dictionary.to_pylist()
        parts = _lists([*self._plain(stems), *self._plain(tails), *self._each(rest), [], [] if end is None else [end]], self.kind)
        # Two parts for each word, then the word's ids are those of both.
        yes = plain.to_numpy(zero_copy_only=False)
        none = len(parts) - 2
        pair = np.full((len(words) + 1, 2), none, np.int64)
        pair[:-1][yes, 0] = stem.indices.to_numpy()
        pair[:-1][yes, 1] = tail.indices.to_numpy() + len(stems)
        pair[:-1][~yes, 0] = np.arange(len(rest)) + len(stems) + len(tails)
        pair[-1, 0] = none + 1
        both = parts.take(pa.array(pair.ravel()))
        return pa.ListArray.from_arrays(pa.array(both.offsets.to_numpy()[::2]), both.values)

    def encode(self, texts: pa.Array, end: int | None = None) -> pa.BinaryArray:
        """Each text's ids as little-endian unsigned integers (2 bytes each for vocabularies up to 65,536, else 4), with
        the end id appended; a null text counts as empty."""
        texts = pc.fill_null(texts, "")
        tail = [] if end is None else [end]
        if not self.by_word:
            lists = _lists([ids + tail for ids in self._each(texts.to_pylist())], self.kind)
            offsets = lists.offsets.to_numpy()
        else:
            words = pc.ascii_split_whitespace(texts)
            coded = words.values.dictionary_encode()
            known = self._words(coded.dictionary, end)
            ends = words.offsets.to_numpy()[1:]
            codes = np.insert(coded.indices.to_numpy(), ends, len(known) - 1)
            lists = known.take(pa.array(codes))
            offsets = np.concatenate((lists.offsets.to_numpy()[:1], lists.offsets.to_numpy()[ends + np.arange(1, len(ends) + 1)]))
        width = np.dtype(self.kind).itemsize
        raw = lists.values.to_numpy().view(np.uint8)
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((offsets * width).astype(np.int32)), pa.py_buffer(raw)])


def chunks(texts: pa.Array, most: int = 1 << 24) -> Iterator[tuple[int, pa.Array]]:
    """(place, texts) of about `most` bytes each, or one longer text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield at, texts.slice(at, stop - at)
        at = stop


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def scaled(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies of sum 2**scale, at least 1 for every id that occurs."""
    total, size = int(counts.sum()), 1 << scale
    if not total:
        return np.zeros(len(counts), np.int64)
    if (counts > 0).sum() > size:
        raise ValueError("more token ids than frequency units")
    out = np.where(counts > 0, np.maximum(1, counts.astype(object) * size // total), 0).astype(np.int64)
    over = int(out.sum()) - size
    for i in np.argsort(-out, kind="stable"):
        if not over:
            break
        step = min(over, int(out[i]) - 1) if over > 0 else over
        out[i] -= step
        over -= step
    return out


class Coder:
    def __init__(self, frequencies: np.ndarray, scale: int = SCALE):
        self.scale, self.frequency = U(scale), frequencies.astype(U)
        self.start = np.concatenate(([0], np.cumsum(frequencies)[:-1])).astype(U)
        self.symbol = np.repeat(np.arange(len(frequencies), dtype=np.uint32), frequencies)

    def encode(self, ids: np.ndarray) -> bytes:
        lanes = max(1, min(LANES, len(ids)))
        steps = -(-len(ids) // lanes)
        state = np.full(lanes, _LOW)
        words, sizes, marks = [], [], []
        top = U(63) - self.scale
        for i in range(steps - 1, -1, -1):
            row = ids[i * lanes : (i + 1) * lanes]
            n = len(row)
            x, f = state[:n], self.frequency[row]
            full = x >= (f << top)
            words.append((x[full] & U(0xFFFFFFFF)).astype("<u4"))
            sizes.append(int(full.sum()))
            x = np.where(full, x >> U(32), x)
            q = x // f
            state[:n] = (q << self.scale) + (x - q * f) + self.start[row]
            if i % CHECKPOINT == 0 and i:
                marks.append((i, sum(sizes), state.astype("<u8").tobytes()))
        coded = b"".join(w.tobytes() for w in reversed(words))
        total = len(coded) // 4
        head = _HEAD.pack(MAGIC, len(ids), lanes, len(marks), total) + state.astype("<u8").tobytes()
        for i, after, states in reversed(marks):  # words that stand before step i
            head += struct.pack("<II", i, total - after) + states
        body = head + coded
        return body + struct.pack("<I", zlib.crc32(body))

    def decode(self, block: bytes, first_mark: int = 0, last_mark: int | None = None) -> np.ndarray:
        """The ids between two checkpoints (0: the start of the block; None: its end)."""
        body, (check,) = block[:-4], struct.unpack("<I", block[-4:])
        if zlib.crc32(body) != check or body[:4] != MAGIC:
            raise ValueError("damaged block")
        _, n, lanes, marks, total = _HEAD.unpack_from(body)
        at = _HEAD.size
        begin = [(0, 0, at)]
        at += 8 * lanes
        for _ in range(marks):
            step, word = struct.unpack_from("<II", body, at)
            begin.append((step, word, at + 8))
            at += 8 + 8 * lanes
        words = np.frombuffer(body, "<u4", total, at).astype(U)
        step, word, place = begin[first_mark]
        end = begin[last_mark][0] if last_mark is not None and last_mark <= marks else -(-n // lanes)
        state = np.frombuffer(body, "<u8", lanes, place).astype(U)
        mask = U((1 << int(self.scale)) - 1)
        out = []
        for i in range(step, end):
            k = min(lanes, n - i * lanes)
            x = state[:k]
            slot = x & mask
            row = self.symbol[slot]
            x = self.frequency[row] * (x >> self.scale) + slot - self.start[row]
            low = np.flatnonzero(x < _LOW)
            x[low] = (x[low] << U(32)) | words[word : word + len(low)]
            word += len(low)
            state[:k] = x
            out.append(row)
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def tokenized(docs: DataFrame, path: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned integers of WordEncoder's kind, with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(1)):
                ids = encoder(path).encode(texts, end)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), ids], names=["doc_id", "ids"])

    picked = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return picked.mapInArrow(run, "doc_id long, ids binary")


def _tally(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                now = np.bincount(np.frombuffer(b"".join(batch.column(0)[at : at + 1000].to_pylist()), kind))
                if len(now) > len(total):
                    total = np.pad(total, (0, len(now) - len(total)))
                total[: len(now)] += now
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    return run


def _coder(spark: SparkSession, table: DataFrame) -> Coder | None:
    """From the frequency table, which has one row per id of the vocabulary at most."""
    rows = table.toPandas()
    if not len(rows):
        return None
    f = np.zeros(int(rows["id"].max()) + 1, np.int64)
    f[rows["id"]] = rows["frequency"]
    return Coder(f)


def write_store(tokens: DataFrame, path: str, kind: str = "<u4") -> None:
    """Write tokens(doc_id, ids as integers of that kind) in ascending doc_id (null first; rows of one id by a hash of their ids)."""
    spark = tokens.sparkSession
    counts = tokens.select("ids").mapInArrow(_tally(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    dense = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 0, np.int64)
    dense[counts["id"]] = counts["n"]
    frequency = scaled(dense)
    at = np.flatnonzero(frequency)
    table = spark.createDataFrame([(int(i), int(frequency[i])) for i in at], "id long, frequency long")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(frequency)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, number, start = Coder(shared.value), TaskContext.get().partitionId(), 0, 0
        docs, parts, held = [], [], 0
        width = np.dtype(kind).itemsize

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), kind)
            sizes = [len(p) // width for p in parts]
            row = [[shard], [number], [start], [docs], [sizes], [coder.encode(ids)]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], names=_BLOCK_NAMES)

        for batch in batches:
            for i, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs.append(i)
                parts.append(ids)
                held += len(ids) // width
                if held >= BLOCK:
                    yield close()
                    number, start = number + 1, start + held
                    docs, parts, held = [], [], 0
        if docs:
            yield close()

    # The hash deals rows without an id, or of one id, over several shards.
    salted = tokens.withColumn("salt", F.xxhash64("ids"))
    ordered = salted.repartitionByRange("doc_id", "salt").sortWithinPartitions("doc_id", "salt", "ids").drop("salt")
    ordered.mapInArrow(blocks, _BLOCK_SCHEMA).write.mode("overwrite").option("compression", "none").parquet(f"{path}/blocks")


_BLOCK_SCHEMA = "shard int, number long, start long, docs array<long>, sizes array<long>, payload binary"
_BLOCK_NAMES = [x.split()[0] for x in _BLOCK_SCHEMA.split(", ")]


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(shard, doc_id, at, n_tokens, ids): at counts the shard's ids before the document; blocks decode in parallel."""
    coder = _coder(spark, spark.read.parquet(f"{path}/table"))
    shared = spark.sparkContext.broadcast(coder)
    names = ["shard", "doc_id", "at", "n_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = shared.value.decode(row["payload"]).astype("<u4")
                ends = np.cumsum(row["sizes"])
                if ends[-1] != len(ids):
                    raise ValueError("a block's documents do not add up")
                starts = ends - row["sizes"]
                blobs = [ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
                columns = [[row["shard"]] * len(blobs), row["docs"], starts + row["start"], row["sizes"], blobs]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    blocks = spark.read.schema(_BLOCK_SCHEMA).parquet(f"{path}/blocks")
    return blocks.mapInArrow(run, "shard int, doc_id long, at long, n_tokens long, ids binary")


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, before): ids in the shards before; one row per shard, so the running sum is over few rows."""
    blocks = spark.read.schema(_BLOCK_SCHEMA).parquet(f"{path}/blocks")
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    sums = blocks.groupBy("shard").agg(F.sum(total).alias("n"))
    line = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("shard", F.coalesce(F.sum("n").over(line), F.lit(0).cast("long")).alias("before"))


def digest(store: DataFrame) -> DataFrame:
    return store.select("shard", "doc_id", "at", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def token_file_digest(docs: DataFrame, tokenizer_path: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, write the store, read it back; one row per row of docs: doc_id, start, n_tokens, ids_crc32.

    Null texts have the end id alone. Null ids come first in the order; rows that repeat an id stand side by side,
    in an order of their ids' hash. Other columns are not read; an empty table gives an empty store.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-store")
    tokens = scratch.save(tokenized(docs, tokenizer_path, end, id_col, text_col), "tokens")
    write_store(tokens, scratch.path("store"), encoder(tokenizer_path).kind)
    scratch.drop("tokens")
    read = digest(read_store(spark, scratch.path("store"))).join(shard_starts(spark, scratch.path("store")), "shard")
    return read.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
