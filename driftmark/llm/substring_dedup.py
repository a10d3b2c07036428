"""Exact removal of repeated byte strings with a sparse, distributed suffix order.

Every 400-byte string that starts at two places or more is removed wherever it stands. Sorting all suffixes of a
corpus would shuffle many times its size, so what is sorted is first chosen, without losing a repeat:

1. Runs. Each 400-byte window is assigned to its minimiser, the 50-byte gram of least hash in it. Equal windows
   have equal minimisers at equal offsets, so a window can repeat only if its minimiser does. Windows that
   share one minimiser place form a run. A run whose bytes seem to repeat as a whole is chosen.
2. Blocks. Runs that share a minimiser but differ as a whole are cut into blocks of 16 windows at places counted
   from the minimiser, hence equally in all copies; a block whose bytes seem to repeat is chosen, and one whose
   common core does not repeat is out. The windows left are chosen one by one.

Choosing is by hashes and map-side combined counts, which may only choose too much. What repeats is told by the
suffixes alone: each chosen run, block or window is the suffix at its first byte, cut at its last byte. Splitters
sampled by Spark range-partition the suffixes by their leading sixteen bytes, then by a hash of the whole suffix, so
that equal suffixes stay neighbours behind any common beginning; each bucket is sorted by multikey quicksort and
neighbours are compared byte by byte. Only rows of one and the same suffix are dealt over buckets by their places, so
that no document, group or bucket gathers all copies of a string; the suffixes at a bucket's two ends are compared
with the ends of all others.
"""

from __future__ import annotations

import bisect
import hashlib
import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.common import Scratch
from driftmark.llm.hashing import BASES, PIECE, U, mix, prefix, spans

GRAM = 50
BLOCK = 16
_LOW = U(PIECE - 1)


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by running minima within blocks from both sides."""
    rows = -(-len(v) // width)
    padded = np.full(rows * width, ~U(0))
    padded[: len(v)] = v
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(v) - width + 1
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _grams(p: np.ndarray) -> np.ndarray:
    at = np.arange(len(p) - GRAM)
    return spans(p, at, at + GRAM)


def pieces(n: int, length: int) -> Iterator[tuple[int, int]]:
    """Byte ranges that together hold every window of `length` once."""
    step = PIECE // 2
    for at in range(0, n - length + 1, step):
        yield at, min(n, at + step + length - 1)


def runs(raw: np.ndarray, length: int) -> list[np.ndarray]:
    """[first window, windows, minimiser's place, minimiser, two hashes of the run's bytes] of a text."""
    out = []
    for start, end in pieces(len(raw), length):
        part = raw[start:end]
        p, q = prefix(part), prefix(part, BASES[1])
        gram = _grams(p)
        least = _sliding_min((gram & ~_LOW) | np.arange(len(gram), dtype=U), length - GRAM + 1)
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        n = np.diff(np.append(first, len(least)))
        place = (least[first] & _LOW).astype(np.int64)
        last = first + n + length - 1
        out.append((first + start, n, place + start, gram[place], spans(p, first, last), spans(q, first, last, BASES[1])))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, U)] * 3


def _table(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    arrays = {k: (v.view(np.int64) if v.dtype == U else v) for k, v in columns.items()}
    return pa.RecordBatch.from_arrays([pa.array(v) for v in arrays.values()], names=list(arrays))


def _gathered(parts: Iterator[dict[str, np.ndarray]], rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Documents' columns as batches of about `rows` rows."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part["k1"])
        if n >= rows:
            yield _table({k: np.concatenate([x[k] for x in held]) for k in part})
            held, n = [], 0
    if n:
        yield _table({k: np.concatenate([x[k] for x in held]) for k in held[0]})


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows one by one, lists of numbers as arrays (null: empty), so that a batch is never held as Python objects."""
    for batch in batches:
        for i in range(batch.num_rows):
            values = (c[i] for c in batch.columns)
            yield tuple((v.values.to_numpy() if v.is_valid else np.zeros(0, np.int64)) if isinstance(v, pa.ListScalar) else v.as_py() for v in values)


def _keyed(k1: int, k2: int, n: int) -> dict[str, np.ndarray]:
    return {"k1": np.full(n, k1, np.int64), "k2": np.full(n, k2, np.int64)}


def _run_rows(length: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for k1, k2, text in _documents(batches):
            raw = np.frombuffer(text.encode(), np.uint8)
            if len(raw) >= length:
                first, n, place, gram, h1, h2 = runs(raw, length)
                yield _keyed(k1, k2, len(first)) | {"first": first, "n": n, "place": place, "core": gram, "h1": h1, "h2": h2}

    return lambda batches: _gathered(each(batches))


def block_rows(raw: np.ndarray, first: np.ndarray, n: np.ndarray, place: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """The blocks of runs. Offsets count back from the minimiser: window w has offset place - w."""
    low, high = place - (first + n - 1), place - first
    count = high // BLOCK - low // BLOCK + 1
    of = np.repeat(np.arange(len(first)), count)
    j = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low // BLOCK, count)
    t0, t1 = np.maximum(j * BLOCK, low[of]), np.minimum(j * BLOCK + BLOCK - 1, high[of])
    base = place[of]
    out: dict[str, list] = {"core": [], "h1": [], "h2": []}
    start, end = base - t1, base - t0 + length
    inner, outer = base - j * BLOCK, base - j * BLOCK - BLOCK + 1 + length  # the bytes that all windows of the block share
    salt = mix(j.astype(U))
    for name, a, b, number in (("core", inner, outer, 0), ("h1", start, end, 0), ("h2", start, end, 1)):
        out[name] = long_spans(raw, a, b, number) ^ salt
    return {"first": start, "n": t1 - t0 + 1, "place": base, **out}


def long_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray, number: int) -> np.ndarray:
    """spans() over texts of any length, piece by piece; no span may be longer than half a piece."""
    if len(raw) <= PIECE:
        return spans(prefix(raw, BASES[number]), start, end, BASES[number])
    out, half = np.zeros(len(start), U), PIECE // 2
    for at in np.unique(start // half):
        here = start // half == at
        part = raw[at * half : at * half + PIECE]
        out[here] = spans(prefix(part, BASES[number]), start[here] - at * half, end[here] - at * half, BASES[number])
    return out


def _block_rows(length: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for k1, k2, text, first, n, place in _documents(batches):
            rows = block_rows(np.frombuffer(text.encode(), np.uint8), first, n, place, length)
            yield _keyed(k1, k2, len(rows["n"])) | rows

    return lambda batches: _gathered(each(batches))


#: Suffixes in one batch.
SUFFIXES = 5000
_UNITS = "k1 long, k2 long, first long, suffix binary"


def leading_tokens(suffixes: np.ndarray, at: np.ndarray, size: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes at `depth` words into each suffix (first byte, length in a byte array) as numbers in the order
    of the bytes; bytes behind a suffix's end count as 0."""
    place = at[:, None] + depth * 8 + np.arange(8)
    inside = depth * 8 + np.arange(8) < size[:, None]
    found = np.where(inside, suffixes[np.minimum(place, max(len(suffixes) - 1, 0))], 0).astype(np.uint8)
    return np.ascontiguousarray(found).view(">u8").ravel().astype(U)


def _suffix_rows(length: int):
    """(k1, k2, text, times, lists of first windows, lists of window counts) to the suffixes of those runs of windows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k1, k2, text, times, *lists in _documents(batches):
            raw = text.encode()
            half = len(lists) // 2
            rows = np.unique(np.stack([np.concatenate(lists[:half]), np.concatenate(lists[half:])], 1), axis=0)
            for low in range(0, len(rows), SUFFIXES):
                part = rows[low : low + SUFFIXES]
                cut = pa.array([raw[a : a + n + length - 1] for a, n in part.tolist()], pa.binary())
                columns = [np.full(len(part), k1), np.full(len(part), k2), part[:, 0]]
                for _ in range(times):
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), cut], names=["k1", "k2", "first", "suffix"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in each(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= SUFFIXES:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def multikey_quicksort(suffixes: list[bytes], small: int = 4096) -> np.ndarray:
    """The order of byte strings.

    Each step parts the strings about a pivot token of eight bytes at one depth; the middle, whose tokens are equal
    there, goes on at the next depth. Small parts are sorted at once.
    """
    size = np.fromiter(map(len, suffixes), np.int64, len(suffixes))
    at = np.cumsum(size) - size
    joined = np.frombuffer(b"".join(suffixes), np.uint8)
    order = np.arange(len(suffixes))
    todo = [(0, len(order), 0)]
    while todo:
        low, high, depth = todo.pop()
        rows = order[low:high]
        if high - low < 2:
            continue
        if high - low <= small:
            order[low:high] = sorted(rows.tolist(), key=suffixes.__getitem__)
            continue
        if depth * 8 >= size[rows].max():  # equal but for zero bytes at the end
            order[low:high] = rows[np.argsort(size[rows], kind="stable")]
            continue
        token = leading_tokens(joined, at[rows], size[rows], depth)
        pivot = np.sort(token[[0, len(rows) // 2, -1]])[1]
        less, more = token < pivot, token > pivot
        a, b = low + int(less.sum()), high - int(more.sum())
        order[low:high] = np.concatenate([rows[less], rows[~(less | more)], rows[more]])
        todo += [(low, a, depth), (a, b, depth + 1), (b, high, depth)]
    return order


_SORTED = "edge boolean, hit boolean, k1 long, k2 long, first long, size long, suffix binary"
LEADING = 16


def _edges(line: list[bytes], hashes: np.ndarray) -> np.ndarray:
    """Of suffixes in order: those with the least and with the greatest (leading bytes, hash), the first of equal ones."""
    out = np.zeros(len(line), bool)
    for end, pick in ((0, np.min), (-1, np.max)):
        lead = line[end][:LEADING]
        # In order, the rows of one beginning are neighbours at this end.
        low = bisect.bisect_left(line, lead, key=lambda x: x[:LEADING])
        high = bisect.bisect_right(line, lead, key=lambda x: x[:LEADING])
        rows = low + np.flatnonzero(hashes[low:high] == pick(hashes[low:high]))
        out[[i for k, i in enumerate(rows.tolist()) if not k or line[i] != line[rows[k - 1]]]] = True
    return out


def _sort_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sort one bucket; yield the suffixes equal to a neighbour, and those at both ends of the bucket's range, with their
    bytes, for comparison with other buckets."""
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    rows = pa.Table.from_batches(found)
    suffixes = [x for b in found for x in b.column(b.schema.get_field_index("suffix")).to_pylist()]
    rows = rows.drop_columns(["suffix"])
    found.clear()
    order = multikey_quicksort(suffixes)
    line = [suffixes[i] for i in order.tolist()]
    same = np.fromiter(map(operator.eq, line, line[1:]), bool, len(line) - 1)
    hit = np.zeros(len(order), bool)
    hit[1:] |= same
    hit[:-1] |= same
    edge = _edges(line, rows.column("hash").to_numpy()[order])
    keep = np.flatnonzero(hit | edge)
    places = [rows.column(c).to_numpy()[order[keep]] for c in ("k1", "k2", "first")]
    places.append(np.fromiter((len(line[i]) for i in keep.tolist()), np.int64, len(keep)))
    sample = pa.array([line[i] if edge[i] else None for i in keep.tolist()], pa.binary())
    columns = [*map(pa.array, (edge[keep], hit[keep], *places)), sample]
    yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _SORTED.split(", ")])


def _narrow(scratch: Scratch, units: DataFrame, name: str) -> DataFrame:
    """Units that may hold a repeat, with: full (their bytes seem to repeat as a whole), open (they are to be cut finer).

    Where a core is open, one unit stands for all equal full ones, so that others can still match it.
    """
    repeated = scratch.save(units.groupBy("core").agg(F.count("*").alias("c")).filter("c > 1").select("core"), f"{name}-cores")
    near = scratch.save(units.join(repeated, "core"), f"{name}-near")
    me = F.struct("k1", "k2", "first")
    groups = scratch.save(near.groupBy("core", "h1", "h2").agg(F.count("*").alias("c"), F.min(me).alias("one")), f"{name}-groups")
    unlike = scratch.save(groups.filter("c = 1").groupBy("core").agg(F.lit(True).alias("unlike")), f"{name}-unlike")
    alike = scratch.save(groups.filter("c > 1").select("core", "h1", "h2", "one"), f"{name}-alike")
    out = near.join(alike, ["core", "h1", "h2"], "left").join(unlike, "core", "left")
    full = F.col("one").isNotNull()
    again = F.coalesce("unlike", F.lit(False)) & (~full | (F.col("one") == me))
    return out.select("k1", "k2", "first", "n", "place", full.alias("full"), again.alias("open")).filter("full or open")


def _cut(length: int):
    """(k1, k2, text, first windows, window counts) to what is removed and what stays."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k1, k2, text, first, n in _documents([batch]):
                raw = text.encode()
                edge = np.zeros(len(raw) + 1, np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + n + length - 1, -1)
                gone = np.concatenate(([False], np.cumsum(edge[:-1]) > 0, [False]))
                turns = np.flatnonzero(gone[1:] != gone[:-1])
                starts, ends = turns[::2].tolist(), turns[1::2].tolist()
                kept = hashlib.sha256()
                for a, b in zip([0, *ends], [*starts, len(raw)], strict=True):
                    kept.update(raw[a:b])
                removed = sum(ends) - sum(starts)
                out.append((k1, k2, removed, len(starts), kept.hexdigest(), starts, ends))
            names = ["k1", "k2", "n_removed", "n_spans", "kept_sha256", "starts", "ends"]
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.int64())] * 2
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return go


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, per_bucket: int = 50_000) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends, text_hash.

    starts and ends: the maximal removed byte ranges [start, end), empty where nothing goes. Texts count as UTF-8
    bytes, null as empty; texts under `length` bytes keep all. Repeated rows are copies of each other, also when
    they repeat an id. A null id is allowed and stays null. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeated-spans")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    picked = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    picked = picked.select("id", F.coalesce("id", F.lit(0)).alias("k1"), F.xxhash64("text").alias("k2"), "text")
    keyed = picked.select("k1", "k2", "text")
    unit = "k1 long, k2 long, first long, n long, place long, core long, h1 long, h2 long"

    level1 = scratch.save(keyed.mapInArrow(_run_rows(length), unit), "runs")
    found = scratch.save(_narrow(scratch, level1, "runs"), "runs-found")
    scratch.drop("runs", "runs-near", "runs-groups")
    here = F.struct("first", "n", "place")
    lists = found.groupBy("k1", "k2").agg(F.collect_list(F.when(F.col("open"), here)).alias("open"), F.collect_list(F.when(F.col("full"), here)).alias("full"))
    # Rows of one id and text are one row here, whose suffixes are sorted twice.
    touched = keyed.join(lists, ["k1", "k2"]).groupBy("k1", "k2").agg(
        F.first("text").alias("text"), F.least(F.count("*"), F.lit(2)).alias("times"), F.first("open").alias("open"), F.first("full").alias("full")
    )
    touched = scratch.save(touched, "touched")

    level2 = touched.filter(F.size("open") > 0).select("k1", "k2", "text", "open.first", "open.n", "open.place")
    level2 = scratch.save(level2.mapInArrow(_block_rows(length), unit), "blocks")
    found2 = scratch.save(_narrow(scratch, level2, "blocks"), "blocks-found")
    scratch.drop("blocks", "blocks-near", "blocks-groups")

    # Blocks and single windows; with the runs that seem to repeat they are the suffixes that are sorted.
    here = F.struct("first", "n")
    windows = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.struct((F.col("first") + i).alias("first"), F.lit(1).cast("long").alias("n")))
    left = found2.groupBy("k1", "k2").agg(
        F.collect_list(F.when(F.col("full"), here)).alias("blocks"), F.flatten(F.collect_list(F.when(F.col("open"), windows))).alias("windows")
    )
    level3 = touched.select("k1", "k2", "text", "times", "full").join(left, ["k1", "k2"], "left")
    lists = [F.col(f"{x}.{c}").alias(f"{x}_{c}") for c in ("first", "n") for x in ("full", "blocks", "windows")]
    level3 = level3.select("k1", "k2", "text", "times", *lists)
    level3 = scratch.save(level3.mapInArrow(_suffix_rows(length), _UNITS), "suffixes")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), level3.count() // per_bucket + 1)
    scratch.drop("runs-found", "blocks-found")
    hashed = level3.withColumn("hash", F.xxhash64("suffix"))
    ranged = hashed.repartitionByRange(buckets, F.substring("suffix", 1, LEADING), "hash", "k1", "k2", "first")
    ordered = scratch.save(ranged.mapInArrow(_sort_bucket, _SORTED), "sorted")
    # About two rows a bucket: suffixes that stand at the ends of several buckets.
    edges = ordered.filter("edge")
    across = edges.groupBy("suffix").agg(F.count("*").alias("c")).filter("c > 1").select("suffix")
    places = ["k1", "k2", "first", "size"]
    hits = ordered.filter("hit").select(*places).union(edges.filter("not hit").join(across, "suffix", "left_semi").select(*places))
    hits = hits.withColumn("n", F.col("size") - (length - 1))

    more = hits.groupBy("k1", "k2").agg(F.collect_list(here).alias("more"))
    cut = touched.select("k1", "k2", "text").join(more, ["k1", "k2"], "left").select("k1", "k2", "text", "more.first", "more.n")
    cut = scratch.save(cut.mapInArrow(_cut(length), "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"), "cut")
    scratch.drop("suffixes", "sorted", "touched")
    whole = picked.select("id", "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    none = F.array().cast("array<long>")
    out = whole.join(cut, ["k1", "k2"], "left").select(
        F.col("id").alias("doc_id"), "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        F.coalesce("starts", none).alias("starts"), F.coalesce("ends", none).alias("ends"), F.col("k2").alias("text_hash"),
    )
    return scratch.last(out)


def cut_text(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with the byte ranges of repeated_spans cut out of their texts.

    A range may end within a character: bytes of a character that lost a part are dropped with it, so that the text
    stays valid. A column `chars_col`, if there is one, gets the new number of code points. All rows and columns
    stay. Ranges belong to an id and a text: rows that share an id, a null one included, but not its text keep their own.
    """
    ranges = spans.filter("n_removed > 0").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "starts", "ends")
    ranges = ranges.dropDuplicates(["_id", "_hash"])

    @F.pandas_udf("string")
    def without(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for text, a, b in zip(texts, starts, ends, strict=True):
            if a is not None and text is not None:
                raw = text.encode()
                parts = (raw[x:y] for x, y in zip([0, *b], [*a, len(raw)], strict=True))
                text = b"".join(p.decode(errors="ignore").encode() for p in parts).decode()
            out.append(text)
        return pd.Series(out, dtype=object)

    mine = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == ranges["_hash"]
    joined = docs.join(ranges, docs[id_col].cast("long").eqNullSafe(ranges["_id"]) & mine, "left")
    changed = joined.withColumn(text_col, F.when(F.col("starts").isNull(), F.col(text_col)).otherwise(without(text_col, "starts", "ends")))
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        changed = changed.withColumn(chars_col, F.when(F.col("starts").isNull(), F.col(chars_col)).otherwise(F.length(text_col).cast(kind)))
    return changed.select(*docs.columns)
