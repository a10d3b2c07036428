"""Stretches of words that repeat with a period.

A run is a maximal stretch of words with smallest period q. Every run holds a Lyndon root: a word stretch that is the
longest Lyndon word from its first place, under the order of words or under the reversed one. Baier's first phase of
suffix sorting yields these longest Lyndon words for all places at once: suffixes are grouped by the Lyndon words that
begin them, from the greatest group down, and each group lengthens the words of the places that point to it. The roots
of both orders are then extended to both sides as far as words one period apart agree.

Texts are narrowed first, which loses no run: a run of `least` words and three periods or more is covered by stretches
of `least` * 2 / 3 words that occur in the text again, so only covered words are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.llm.hashing import U, mix, powers, word_hashes


def lyndon_lengths(ranks: list[int]) -> list[int]:
    """For each place the length of the longest Lyndon word that begins there, by Baier's grouping.

    Groups are intervals of a list of places in rising order; a group's first index is its number. The greatest group
    not yet done is final. Each of its places looks back for the nearest place of a smaller group, over pointers of done
    groups; a place that is met by l of them has the group's Lyndon word l times behind its own and moves, with all others
    of its group met as often, to a new group right behind its old one.
    """
    n = len(ranks)
    places = sorted(range(n), key=ranks.__getitem__)
    index, group, size = [0] * n, [0] * n, [0] * n
    first = 0
    for k, i in enumerate(places):
        if k and ranks[i] != ranks[places[k - 1]]:
            first = k
        index[i], group[i] = k, first
        size[first] += 1
    before, length = [-1] * n, [1] * n
    end = n
    while end:
        low = group[places[end - 1]]
        members = places[low:end] if end - low == 1 else sorted(places[low:end])
        end = low
        met: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = before[j]
            before[i] = j
            if j >= 0:
                met[j] = met.get(j, 0) + 1
        word = length[members[0]]
        for times in sorted(set(met.values()), reverse=True):
            moved: dict[int, int] = {}
            here = [j for j, c in met.items() if c == times]
            for j in here:
                g = group[j]
                n_moved = moved[g] = moved.get(g, 0) + 1
                at, other = index[j], places[to := g + size[g] - n_moved]
                places[at], places[to] = other, j
                index[other], index[j] = at, to
                length[j] += times * word
            for g, n_moved in moved.items():
                size[g] -= n_moved
                moved[g] = g + size[g]
                size[g + size[g]] = n_moved  # the same group where all have moved
            for j in here:
                group[j] = moved[group[j]]
    return length


class Extensions:
    """How far equal words go on, to the right of two places or to the left, for arrays of pairs of places."""

    def __init__(self, ranks: np.ndarray):
        self.n = len(ranks)
        up, self.down = powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, U)
        np.cumsum(mix(ranks.astype(U) + U(1)) * up[: self.n], out=self.sums[1:])

    def _hash(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.down[at]

    def _search(self, most: np.ndarray, same) -> np.ndarray:
        found = np.zeros(len(most), np.int64)
        for step in 1 << np.arange(int(most.max(initial=0)).bit_length())[::-1]:
            tried = found + step
            inside = np.flatnonzero(tried <= most)
            good = inside[same(inside, tried[inside])]
            found[good] = tried[good]
        return found

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, i < j."""
        return self._search(self.n - j, lambda k, size: self._hash(i[k], size) == self._hash(j[k], size))

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words that end before i and before j, i < j."""
        return self._search(i, lambda k, size: self._hash(i[k] - size, size) == self._hash(j[k] - size, size))


def _exact(ranks: np.ndarray, start: int, end: int, period: int, root: int) -> tuple[int, int]:
    """The stretch about a root, told by the words themselves; hashes that agree by chance are mended here."""
    if not np.array_equal(ranks[start : end - period], ranks[start + period : end]):
        start, end = root, root + period
    while start and ranks[start - 1] == ranks[start - 1 + period]:
        start -= 1
    while end < len(ranks) and ranks[end] == ranks[end - period]:
        end += 1
    return start, end


def runs_of(ranks: np.ndarray, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of max(least, exponent * period) numbers or more, exponent 2 at least."""
    if len(ranks) < least:
        return []
    order = ranks.tolist()
    top = max(order)
    longer, found = Extensions(ranks), {}
    for numbers in (order, [top - x for x in order]):
        period = np.array(lyndon_lengths(numbers))
        i = np.arange(len(ranks))
        inside = i + period < len(ranks)
        i, period = i[inside], period[inside]
        # Either side of a root of a long run agrees one period on: the word behind it or the word before it.
        back = np.maximum(i - 1, 0)
        near = (ranks[i] == ranks[i + period]) | ((i > 0) & (ranks[back] == ranks[back + period]))
        i, period = i[near], period[near]
        start = i - longer.left(i, i + period)
        end = i + period + longer.right(i, i + period)
        long = end - start >= np.maximum(least, exponent * period)
        found.update(zip(zip(start[long].tolist(), end[long].tolist(), period[long].tolist()), i[long].tolist()))
    exact = {(*_exact(ranks, s, e, p, root), p) for (s, e, p), root in found.items()}
    return sorted((s, e - s, p) for s, e, p in exact if e - s >= max(least, exponent * p))


def covered(words: np.ndarray, width: int) -> np.ndarray:
    """Words, given by hashes, that lie in a stretch of `width` words found more than once; may say too many."""
    n = len(words) - width + 1
    if n < 2:
        return np.zeros(len(words), bool)
    grams, size = words, 1
    while 2 * size <= width:
        grams = mix(grams[:-size] * U(3) + grams[size:])
        size *= 2
    if size < width:  # two overlapping stretches make one
        grams = mix(grams[: n] * U(3) + grams[width - size : width - size + n])
    order = np.argsort(grams, kind="stable")
    line = grams[order]
    same = line[1:] == line[:-1]
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += hit
    edge[width : width + n] -= hit
    return np.cumsum(edge[:-1]) > 0


def find_runs(raw: bytes, words: list[bytes], least: int = 24, exponent: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text's words, by start, then period."""
    if len(words) < least:
        return []
    # A run repeats one period on: `least` - `least` / exponent words at least are found twice, and these cover it.
    inside = np.concatenate(([False], covered(word_hashes(raw), least - least // exponent), [False]))
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    out = []
    for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()):
        number: dict[bytes, int] = {}
        ranks = np.fromiter((number.setdefault(w, len(number)) for w in words[a:b]), np.int64, b - a)
        out += [(a + s, size, p) for s, size, p in runs_of(ranks, least, exponent)]
    return sorted(out, key=lambda run: (run[0], run[2]))


_SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, exponent: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    Words are maximal stretches without ASCII white space, numbered from 0. A run is a stretch of words with smallest
    period q, of max(least, exponent * q) words or more, that no word beside it extends; exponent is 3 at least.
    collapsed: the text's words joined by one space, without words that lie behind the first period of any run.
    Null and empty texts have no words and no runs, and collapse to an empty text. Null and repeated ids pass through,
    repeated rows repeat their result; other columns are not read; an empty table gives no rows. No row is shuffled.
    """
    if exponent < 3:
        raise ValueError("runs of under three periods are not covered by the search")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                count, found, collapsed = [], [], []
                for text in some.column(1):
                    raw = (text.as_py() or "").encode()
                    words = raw.split()
                    runs = find_runs(raw, words, least, exponent)
                    count.append(len(words))
                    found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                    if runs:
                        gone = np.zeros(len(words) + 1, np.int64)
                        for s, n, p in runs:
                            gone[s + p] += 1
                            gone[s + n] -= 1
                        kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                        words = [words[i] for i in kept.tolist()]
                    collapsed.append(b" ".join(words).decode())
                columns = [some.column(0), pa.array(count, pa.int64()), pa.array(found, kind), pa.array(collapsed, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, _SCHEMA)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with periods made in a tenth of the documents, those whose hash h = crc32(id) ends in 0.

    With n words and g = floor(h / 10), each word i >= a becomes word a + (i - a) % p of the document, where a = g % n and
    p = 1 + floor((n - a) / (3 + g % 8)). Other documents, and those without words or id, keep their text.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    n = F.size("w")
    hit = F.coalesce(h % 10 == 0, F.lit(False))
    step = picked.select("doc_id", "text", F.when(hit, _words(F.col("text"))).alias("w"), F.when(hit, g).alias("g"))
    step = step.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    step = step.withColumn("p", F.when(n > 0, 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    at = lambda i: F.when(i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("p")).otherwise(i)
    made = F.array_join(F.transform("w", lambda w, i: F.get("w", at(i))), " ")
    return step.select("doc_id", F.when(n > 0, made).otherwise(F.col("text")).alias("text"))


def run_digest(found: DataFrame) -> DataFrame:
    """Of periodic_runs: doc_id, n_runs, the run with the greatest exponent (ties: smallest start, then period; nulls where
    there is none) as start, length, period and exponent_milli, and SHA-256 of the runs and of the collapsed text."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    wide = lambda c: c.cast("decimal(20,0)")
    best = F.aggregate("runs", none, lambda a, x: F.when(a.isNull() | (wide(x["length"]) * wide(a["period"]) > wide(a["length"]) * wide(x["period"])), x).otherwise(a))
    lines = F.transform("runs", lambda x: F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
