"""Best-fit packing of token sequences into bins of several permitted lengths.

Documents longer than the largest length are cut into pieces. Pieces are dealt at random into groups of bounded
size, with their ids, and each group is packed by best fit decreasing. A piece that fits no open bin opens one of the
length that costs least per token, given what the pieces still unplaced would fill of it; all permitted lengths
compete at every opening. Packings that open every bin with one least length compete with that one by total cost.
Finally each bin is downsized to the smallest length that holds its contents, and its ids are written in place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.common import Scratch
from driftmark.llm.token_store import encoder, tokenized

CAPACITIES = (512, 1024, 2048, 4096)


def training_cost(capacity: int) -> float:
    """Relative cost of one sequence: linear layers, attention, and a fixed part."""
    return 16 + capacity + capacity * capacity / 16384


class Unplaced:
    """The lengths still to be placed, as counts by length."""

    def __init__(self, lengths: list[int]):
        self.count: dict[int, int] = {}
        for n in lengths:
            self.count[n] = self.count.get(n, 0) + 1
        self.mask = sum(1 << n for n in self.count)  # bit n: a piece of n tokens is left

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.mask ^= 1 << n

    def fill(self, space: int) -> int:
        """Tokens that fill that space, the longest piece that fits first."""
        filled, mask = 0, self.mask
        while space:
            mask &= (1 << space + 1) - 1
            n = mask.bit_length() - 1
            if n < 1:
                break
            here = n * min(self.count[n], space // n)
            filled, space, mask = filled + here, space - here, mask ^ (1 << n)
        return filled


def least_cost(n: int, rest: Unplaced, capacities: tuple[int, ...], cost: Callable[[int], float]) -> int:
    """The length to open for a piece of n tokens: the least cost per token of the bin as the pieces left would fill it."""
    best = None
    for c in capacities:
        if c >= n:
            used = n + rest.fill(c - n)
            price = cost(next(x for x in capacities if x >= used)) / used
            if best is None or price < best[0]:
                best = (price, c)
    return best[1]


def best_fit(
    lengths: list[int], capacities: tuple[int, ...], least: int | None = None, cost: Callable[[int], float] = training_cost
) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, offset in it, contents of each bin) by best fit decreasing.

    A new bin gets the length of least cost, or if `least` is given, the smallest of at least that which holds its
    first piece.
    """
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    rest = Unplaced(lengths) if least is None else None
    room: list[list[int]] = [[] for _ in range(capacities[-1] + 1)]  # open bins by the space they have left
    mask = 0  # bit s: a bin with s left is open
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    used: list[int] = []
    for i in order:
        n = lengths[i]
        if rest is not None:
            rest.take(n)
        fits = mask >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            b = room[space].pop()
            if not room[space]:
                mask ^= 1 << space
        else:
            b = len(used)
            used.append(0)
            space = next(c for c in capacities if c >= max(n, least)) if rest is None else least_cost(n, rest, capacities, cost)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        left = space - n
        if left:
            room[left].append(b)
            mask |= 1 << left
    return bins, offsets, used


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = training_cost) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, offset in it, final capacity of each bin): opening by cost, or the one least length for all
    bins that costs less in all."""
    best = None
    for least in (None, *capacities):
        bins, offsets, used = best_fit(lengths, capacities, least, cost)
        final = [next(c for c in capacities if c >= u) for u in used]
        total = sum(map(cost, final))
        if best is None or total < best[0]:
            best = (total, bins, offsets, final)
    return best[1:]


_BINS = "bin_id long, capacity long, doc_ids array<long>, starts array<long>, sizes array<long>, ids binary"


def packed_sequences(
    docs: DataFrame,
    tokenizer_path: str,
    end: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacities: tuple[int, ...] = CAPACITIES,
    cost: Callable[[int], float] = training_cost,
    group_size: int = 2000,
) -> DataFrame:
    """One row per training sequence: bin_id, capacity, doc_ids, starts, sizes, ids.

    The lists hold a sequence's pieces in order: document, first token in the document, tokens. ids are the tokens of
    all pieces, little-endian unsigned integers of the encoder's kind; what is missing up to capacity is padding.
    Every token of every document is in one piece, the end id appended to each document included, so that a null
    text has one token. A bin's contents are at most its capacity and more than the next smaller permitted length.
    Groups hold about `group_size` pieces at every input size. Null and repeated ids are packed like others, repeated
    rows are packed each; other columns are not read; an empty table gives no rows.
    """
    capacities = tuple(sorted(capacities))
    scratch = Scratch(docs.sparkSession, "packing")
    width = np.dtype(encoder(tokenizer_path).kind).itemsize
    rows = tokenized(docs, tokenizer_path, end, id_col, text_col)
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), (F.octet_length("ids") / width).cast("long").alias("n"), "ids")
    rows = scratch.save(rows, "tokens")
    most = capacities[-1]
    begin = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(most).cast("long"))
    pieces = rows.filter("n > 0").select("doc_id", "row", "ids", F.explode(begin).alias("start"))
    pieces = pieces.select("doc_id", "row", "start", F.expr(f"substring(ids, int(start * {width} + 1), {most * width})").alias("ids"))
    total = rows.filter("n > 0").agg(F.sum(F.ceil(F.col("n") / most))).first()[0] or 0
    groups = -(-total // group_size) or 1
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("row", "start"), F.lit(groups)))

    def run(found: pa.Table) -> pa.Table:
        found = found.sort_by([("row", "ascending"), ("start", "ascending")])
        sizes = pc.divide(pc.binary_length(found["ids"]), width).to_pylist()
        bins, offsets, final = pack(sizes, capacities, cost)
        order = np.lexsort((offsets, bins))
        found, of, sizes = found.take(order), np.array(bins, np.int64)[order], np.array(sizes, np.int64)[order]
        count = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(final))))).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(count), found["ids"].combine_chunks())
        part = found["part"][0].as_py() * (1 << 32)
        lists = (pa.ListArray.from_arrays(pa.array(count), c) for c in (found["doc_id"].combine_chunks(), found["start"].combine_chunks(), pa.array(sizes)))
        return pa.table([pa.array(part + np.arange(len(final))), pa.array(final, pa.int64()), *lists, pc.binary_join(ids, b"")], names=[x.split()[0] for x in _BINS.split(", ")])

    return scratch.last(pieces.groupBy("part").applyInArrow(run, _BINS), "bins")


def packed_pieces(bins: DataFrame, width: int = 2) -> DataFrame:
    """One row per piece of packed_sequences: doc_id, start, n_tokens, bin_id, capacity, bin_offset, ids_crc32 (of the
    ids as they stand in the sequence). width: bytes of an id."""
    before = lambda i: F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x)
    piece = lambda n, i: F.struct(F.get("doc_ids", i).alias("doc_id"), F.get("starts", i).alias("start"), n.alias("n_tokens"), before(i).alias("bin_offset"))
    rows = bins.select("bin_id", "capacity", "ids", F.transform("sizes", piece).alias("pieces"))
    check = "x -> crc32(substring(ids, int(x.bin_offset * {0} + 1), int(x.n_tokens * {0})))".format(width)
    rows = rows.select("bin_id", "capacity", F.explode(F.arrays_zip("pieces", F.expr(f"transform(pieces, {check})").alias("sums"))).alias("x"))
    return rows.select("x.pieces.doc_id", "x.pieces.start", "x.pieces.n_tokens", "bin_id", "capacity", "x.pieces.bin_offset", F.col("x.sums").alias("ids_crc32"))


def training_rows(bins: DataFrame, kind: str = "<u2", pad: int = 0) -> DataFrame:
    """packed_sequences as arrays of `capacity` numbers: bin_id, ids, segment_ids (1 for the first piece; 0: padding),
    position_ids (from 0 in each piece)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b, capacity, sizes, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.full(capacity, pad, np.int64)
                held = np.frombuffer(raw, kind)
                ids[: len(held)] = held
                segment, position = np.zeros(capacity, np.int32), np.zeros(capacity, np.int32)
                segment[: len(held)] = np.repeat(np.arange(1, len(sizes) + 1), sizes)
                position[: len(held)] = np.arange(len(held)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                out.append((b, ids, segment, position))
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["bin_id", "ids", "segment_ids", "position_ids"])

    picked = bins.select("bin_id", "capacity", "sizes", "ids")
    return picked.mapInArrow(run, "bin_id long, ids array<long>, segment_ids array<int>, position_ids array<int>")


def pack_documents(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """packed_sequences of docs, written and read back as packed_pieces: one row per piece."""
    return packed_pieces(packed_sequences(docs, tokenizer_path, **options), np.dtype(encoder(tokenizer_path).kind).itemsize)
