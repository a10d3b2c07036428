"""Token counts by the tokenizer's own library, in batches of equal bytes.

Only lengths leave a batch. Long texts are split where no token can cross: at a single space between two characters
that are not white space, if the tokenizer file's rules show that its tokens never span such a place; the counts of
the parts then add up to the text's. Texts of other files, or without such a place, are counted whole. Very long texts
are dealt over the cluster part by part, all others are counted where they are read.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.sp_fst import NORMAL, SPACE, USER_DEFINED, _fields
from driftmark.llm.token_store import _word_rules, chunks

#: Bytes of text that one call of the library gets; characters of a part of a long text.
BATCH = 1 << 20
PART = 1 << 15
#: Texts of more bytes are dealt over the cluster.
DEALT = 1 << 22
_PLACE = re.compile(rf"(?<=[^\s{SPACE}]) (?=[^\s{SPACE}])")


class PieceLengths:
    """Counts of a SentencePiece model file, as the library encodes by default."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, trainer, rules = [], {}, {}
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    d = dict(_fields(value))
                    pieces += [d[1].decode()] if d.get(3, NORMAL) in (NORMAL, USER_DEFINED) else []
                elif number in (2, 3):
                    (trainer if number == 2 else rules).update(_fields(value))
        # Splits need a normaliser that maps nothing, escaped spaces in front of words, and no piece with a space behind a letter.
        plain = not rules.get(2) and rules.get(5, 1) and not trainer.get(24, 0)
        self.splits = bool(plain) and not any(SPACE in p.lstrip(SPACE) or " " in p for p in pieces)
        self.skip = 1 if rules.get(3, 1) else 0  # with a prefix added to every part, the space itself goes

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]


class FileLengths:
    """Counts of a tokenizers file: nothing added, cut or padded; special strings inside texts as the file has them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        pre = told.get("pre_tokenizer") or {}
        by_bytes = told.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        whole = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in told.get("added_tokens", []))
        self.splits = whole and (_word_rules(path) or by_bytes)
        self.skip = 0

    def count(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@functools.lru_cache(maxsize=2)
def lengths(path: str) -> PieceLengths | FileLengths:
    return (FileLengths if path.endswith(".json") else PieceLengths)(path)


def parts(text: str, counter: PieceLengths | FileLengths, most: int = PART) -> list[str]:
    """The text in parts of about `most` characters that no token crosses."""
    if len(text) <= most or not counter.splits:
        return [text]
    out, at = [], 0
    while len(text) - at > most and (found := _PLACE.search(text, at + most)):
        out.append(text[at : found.start()])
        at = found.start() + counter.skip
    return [*out, text[at:]]


def _batches(texts: list[str], counter: PieceLengths | FileLengths) -> Iterator[tuple[list[int], list[str]]]:
    """(owners, parts) of about BATCH bytes each, as characters of one byte at least."""
    owners, held, size = [], [], 0
    for i, text in enumerate(texts):
        for part in parts(text, counter):
            owners.append(i)
            held.append(part)
            size += len(part)
            if size >= BATCH:
                yield owners, held
                owners, held, size = [], [], 0
    if held:
        yield owners, held


def count_tokens(texts: pa.Array, path: str) -> np.ndarray:
    """The number of tokens of each text; a null text counts as empty."""
    counter, out = lengths(path), np.zeros(len(texts), np.int64)
    for at, some in chunks(texts, BATCH):
        for owners, held in _batches([t or "" for t in some.to_pylist()], counter):
            np.add.at(out, np.array(owners) + at, counter.count(held))
    return out


def _counted(path: str, text_at: int):
    """Batches with their column of texts replaced by their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[text_at] = pa.array(count_tokens(columns[text_at], path))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:text_at], "n_tokens", *batch.schema.names[text_at + 1 :]])

    return run


def _split(path: str, most: int):
    """(id, bytes, row, text) to one row a part of about `most` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = lengths(path)
        for batch in batches:
            for i in range(batch.num_rows):
                cut = parts(batch.column(3)[i].as_py(), counter, most)
                for k in range(0, len(cut), 8):
                    some = cut[k : k + 8]
                    same = batch.slice(i, 1).take(pa.array([0] * len(some)))
                    yield pa.RecordBatch.from_arrays([*same.columns[:3], pa.array(some, pa.string())], names=batch.schema.names)

    return run


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, dealt: int = DEALT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    path: a tokenizers file (.json) or a SentencePiece model (.model), read by its library without begin, end or added
    tokens. Null and empty texts have no tokens. Null and repeated ids pass through, repeated rows repeat their result;
    other columns are not read; an empty table gives no rows. Texts of more than `dealt` bytes are split and their parts
    dealt over the cluster; only those are shuffled.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    near = picked.filter(F.col("n_bytes") <= dealt).mapInArrow(_counted(path, 2), "doc_id long, n_bytes long, n_tokens long")
    far = picked.filter(F.col("n_bytes") > dealt).select("doc_id", "n_bytes", F.monotonically_increasing_id().alias("row"), "text")
    spread = far.mapInArrow(_split(path, min(BATCH, dealt)), "doc_id long, n_bytes long, row long, text string").repartition(docs.sparkSession.sparkContext.defaultParallelism)
    long = spread.mapInArrow(_counted(path, 3), "doc_id long, n_bytes long, row long, n_tokens long")
    long = long.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens")).drop("row")
    return near.union(long).withColumn("over_limit", F.col("n_tokens") > limit)
