"""Near-duplicate documents by DartMinHash.

A document is the multiset of its five-word shingles, each weighted by its count; similarity is the weighted
Jaccard index. Signatures come from hashed darts: every element's half-plane of (weight, rank) holds a fixed
random scatter of darts, the same for all documents; a document keeps, for each of k coordinates, the dart of
lowest rank that lies under its weights. Two documents agree in a coordinate with the probability of their
similarity. Signatures are banded, bands are joined with Spark, and every candidate is verified on its
whole shingle multisets.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.common import Scratch, connected_components, hot_join
from driftmark.llm.hashing import U, mix, shingles

#: Darts in a cell of area 1, by the upper 16 bits of its hash: Poisson numbers of mean 1.
_POISSON = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)]), (np.arange(1 << 16) + 0.5) / (1 << 16), side="right")
_UNIT = 2.0**-53


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> U(11)) * _UNIT


def dart_minhash(elements: np.ndarray, weights: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """k hash values of the weighted set (element hashes, weights above 0).

    The plane of each element is cut into cells of area 1, of weight [0, 1), [1, 2), [2, 4), ... and of
    ranks to match, each with a Poisson number of darts. Ranks are searched up to a bound at which about
    k (ln k + 2) darts lie under the weights; when a coordinate is still empty, the bound is doubled.
    """
    bound = k * (math.log(k) + 2) / float(weights.sum())
    while True:
        ids, ranks = [], []
        low, high, level = 0.0, 1.0, 0
        while True:
            over = weights > low
            if not over.any():
                break
            own, most, width = elements[over], weights[over], high - low
            cells = int(math.ceil(bound * width))
            at = mix(np.arange(cells, dtype=U) + U(((seed << 8) + level) << 32))
            cell = mix(own[:, None] ^ at[None, :])
            cell = cell.ravel()
            count = _POISSON[cell >> U(48)]
            where = np.repeat(np.arange(count.size), count)
            turn = np.arange(where.size) - np.repeat(np.cumsum(count) - count, count)
            dart = mix(cell[where] + (turn + 1).astype(U) * U(0x9E3779B97F4A7C15))
            rank = (where % cells + _uniform(mix(dart ^ U(0x5851F42D4C957F2D)))) / width
            hit = rank <= bound
            if most.min() < high:  # else all of every cell lies under the weights
                hit &= low + _uniform(mix(dart ^ U(0x14057B7EF767814F))) * width < most[where // cells]
            ids.append(dart[hit])
            ranks.append(rank[hit])
            low, high, level = high, high * 2, level + 1
        dart, rank = np.concatenate(ids), np.concatenate(ranks)
        late = np.argsort(rank)[::-1]
        signature = np.zeros(k, U)
        full = np.zeros(k, bool)
        slot = (dart[late] >> U(32)).astype(np.int64) % k
        signature[slot] = dart[late]  # the earliest dart is written last
        full[slot] = True
        if full.all():
            return signature
        bound *= 2


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    grid = signature.reshape(-1, rows)
    key = np.arange(len(grid), dtype=U)
    for i in range(rows):
        key = mix(key * U(0x9E3779B97F4A7C15) + grid[:, i])
    return key


#: Most rows of three numbers that are broadcast.
BROADCAST_ROWS = 1_000_000
#: Bits of each dart that a sketch keeps.
SKETCH_BITS = 4


def sketch(signature: np.ndarray) -> np.ndarray:
    """SKETCH_BITS of every coordinate, as bit planes of 64-bit words."""
    padded = np.zeros(-(-len(signature) // 64) * 64, U)
    padded[: len(signature)] = mix(signature)
    planes = [np.packbits(((padded >> U(b)) & U(1)).astype(np.uint8)).view(U) for b in range(SKETCH_BITS)]
    return np.concatenate(planes)


def most_mismatches(k: int, threshold: float, sigmas: float = 4.0) -> int:
    """Coordinates in which the sketches of a pair of that similarity differ, `sigmas` deviations up."""
    p = (1 - threshold) * (1 - 2.0**-SKETCH_BITS)
    return math.ceil(k * p + sigmas * math.sqrt(k * p * (1 - p)))


def weighted_set(text: str | None, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles((text or "").encode(), width), return_counts=True)


def _sign(width: int, bands: int, rows: int, seed: int):
    """(id, hash, text) to (id, hash, size, c1, c2, keys, sketch): c1 and c2 are equal for equal multisets; no keys without
    words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, c1, c2, keys, drawn = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                elements, counts = weighted_set(text, width)
                size.append(int(counts.sum()))
                if not len(elements):
                    c1.append(None), c2.append(None), keys.append(None), drawn.append(None)
                    continue
                each = mix(elements + counts.astype(U) * U(0xD6E8FEB86659FD93))
                c1.append(int(each.sum().astype(np.int64)))
                c2.append(int(mix(each ^ U(0xA0761D6478BD642F)).sum().astype(np.int64)))
                signature = dart_minhash(elements, counts.astype(float), bands * rows, seed)
                keys.append(band_keys(signature, rows).view(np.int64))
                drawn.append(sketch(signature).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *(pa.array(c, pa.int64()) for c in (size, c1, c2)), *(pa.array(c, pa.list_(pa.int64())) for c in (keys, drawn))],
                names=["id", "hash", "size", "c1", "c2", "keys", "sketch"],
            )

    return run


def _multisets(width: int):
    """(id, text) to (id, hashes in order, counts as bytes: a list of 32-bit numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [weighted_set(text, width) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([e.tobytes() for e, _ in pairs], pa.binary()),
                    pa.array([c.astype(np.int32).tobytes() for _, c in pairs], pa.binary()),
                ],
                names=["id", "elements", "counts"],
            )

    return run


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            cols = [batch.column(i) for i in range(2, 6)]
            for i in range(batch.num_rows):
                ea, ca, eb, cb = (np.frombuffer(c[i].as_buffer(), t) for c, t in zip(cols, (U, np.int32, U, np.int32), strict=True))
                at = np.searchsorted(eb, ea)
                at[at == len(eb)] = 0
                same = eb[at] == ea
                shared = int(np.minimum(ca[same], cb[at[same]]).sum())
                hit.append(shared >= threshold * (int(ca.sum()) + int(cb.sum()) - shared) - 1e-9)
            hit = pa.array(hit, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(hit), batch.column(1).filter(hit)], names=["a", "b"])

    return run


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.8,
    width: int = 5,
    bands: int = 56,
    rows: int = 8,
    seed: int = 1,
) -> DataFrame:
    """One row per row of docs: doc_id, class_id (smallest id reachable by links), kept (doc_id = class_id).

    A link joins two documents whose weighted Jaccard index is at least `threshold`; at 0.8 a pair is missed by
    all bands with probability under 4e-5. Equal multisets form one class before banding. In each bucket every
    document meets the smallest id; then, in buckets that still hold several components, the documents outside
    the first one's component meet the members of other components, where sketches of their whole signatures do
    not rule a link out (four standard deviations). No bucket or partner is capped.

    Texts shorter than `width` words are one shingle; texts without words, null ones included, and rows with a
    null id link with nothing and are kept. Repeated rows fall in one class; rows that repeat an id with other text
    are linked by it, and each of their texts links with others. Other columns are not read. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    picked = picked.select("id", F.xxhash64("text").alias("hash"), "text")
    signed = picked.mapInArrow(_sign(width, bands, rows, seed), "id long, hash long, size long, c1 long, c2 long, keys array<long>, sketch array<long>")
    signed = scratch.save(signed, "signed")
    usable = signed.filter("id is not null and c1 is not null")
    # Different multisets are numbered, since an id may have several, in the order of their smallest ids.
    copies = usable.groupBy("c1", "c2").agg(F.min("id").alias("id")).repartitionByRange("id").sortWithinPartitions("id", "c1", "c2")
    copies = scratch.save(copies.withColumn("rep", F.monotonically_increasing_id()), "copies")
    # Rows of one multiset carry equal keys, so those of any row with its smallest id stand for it.
    chosen = usable.join(copies, ["id", "c1", "c2"]).dropDuplicates(["id", "c1", "c2"])
    chosen = scratch.save(chosen.select("rep", F.col("id").alias("least"), "hash", "c1", "c2", "size", "keys", "sketch"), "reps")
    members = usable.select("id", "c1", "c2").join(copies.withColumnRenamed("id", "least"), ["c1", "c2"])
    members = scratch.save(members.select("id", "rep", "least"), "members")
    places = chosen.select(F.col("rep"), F.col("least").alias("id"), "hash")
    reps = chosen.select(F.col("rep").alias("id"), "size", "keys", "sketch")
    shared_ids = members.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a <> z").select("id", "a")
    by_id = scratch.save(members.select("id", "rep").join(shared_ids, "id").filter("a <> rep").select("a", F.col("rep").alias("b")).distinct(), "by-id")

    buckets = reps.select("id", "size", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("id").alias("center"), F.min_by("size", "id").alias("center_size"), F.max("id").alias("last"))
    shared = scratch.save(shared.filter("center <> last").select("key", "center", "center_size"), "shared")
    fits = lambda x, y: F.least(x, y) >= threshold * F.greatest(x, y) - 1e-9
    inside = scratch.save(buckets.join(shared, "key"), "inside")
    stars = inside.filter((F.col("id") != F.col("center")) & fits(F.col("size"), F.col("center_size")))
    stars = stars.select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
    tried = scratch.save(stars, "stars")
    links = _linked(scratch, picked, places, tried, width, threshold, "links1")
    parts = connected_components(scratch, links)

    # Second round: buckets that hold more than one component.
    labelled = inside.join(parts.withColumnRenamed("node", "id"), "id", "left")
    labelled = labelled.select("key", "id", "size", "center", F.coalesce("component", "id").alias("part"))
    labelled = scratch.save(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(F.min("part").alias("p0"), F.max("part").alias("p1"), F.min_by("part", "id").alias("home"))
    mixed = scratch.save(mixed.filter("p0 <> p1").select("key", "home"), "mixed")
    there = labelled.join(mixed, "key").join(reps.select("id", "keys", "sketch"), "id")
    side = lambda n, keep: there.filter(keep).select("key", "home", *(F.col(c).alias(f"{c}{n}") for c in ("id", "size", "part", "keys", "sketch")))
    x, y = side(1, "part <> home"), side(2, "id <> center").drop("home")
    planes = -(-bands * rows // 64)
    differ = F.lit(0)
    for i in range(planes):
        bits = [F.col("sketch1")[i + planes * b].bitwiseXOR(F.col("sketch2")[i + planes * b]) for b in range(SKETCH_BITS)]
        differ = differ + F.bit_count(functools.reduce(lambda a, b: a.bitwiseOR(b), bits))
    met = x.join(y, "key").filter(
        ((F.col("part2") == F.col("home")) | ((F.col("id1") < F.col("id2")) & (F.col("part1") != F.col("part2"))))
        & fits(F.col("size1"), F.col("size2"))
        & (differ <= most_mismatches(bands * rows, threshold))
        # Of the buckets that two documents share, the first one speaks.
        & (F.expr("element_at(filter(zip_with(keys1, keys2, (a, b) -> if(a = b, a, null)), k -> k IS NOT NULL), 1)") == F.col("key"))
    )
    met = met.select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b"))
    more = _linked(scratch, picked, places, scratch.save(met, "met"), width, threshold, "links2")
    scratch.drop("inside", "labelled", "mixed", "shared")
    parts = connected_components(scratch, scratch.save(links.union(more).union(by_id), "links"))

    # A class is named by the smallest id of its multisets.
    n_parts = parts.count()
    named = parts.join(places.select(F.col("rep").alias("node"), "id"), "node").groupBy("component").agg(F.min("id").alias("class_id"))
    named = hot_join(parts, named, "component", "node", parts, n_parts).select(F.col("node").alias("rep"), "class_id")
    classes = members.join(named, "rep", "left").groupBy("id").agg(F.min(F.coalesce("class_id", "least")).alias("class_id"))
    out = signed.select("id").join(classes, "id", "left")
    class_id = F.coalesce("class_id", "id")
    return scratch.last(out.select(F.col("id").alias("doc_id"), class_id.alias("class_id"), F.coalesce(F.col("id") == class_id, F.lit(True)).alias("kept")))


def _linked(scratch: Scratch, picked: DataFrame, places: DataFrame, pairs: DataFrame, width: int, threshold: float, name: str) -> DataFrame:
    """The pairs(a, b) of numbered multisets, whose texts stand at places(rep, id, hash), that reach the threshold."""
    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
    wanted = scratch.save(places.join(wanted, "rep"), f"{name}-ids")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)  # so that texts are filtered where they are read
    texts = picked.join(wanted, ["id", "hash"]).dropDuplicates(["id", "hash"]).select(F.col("rep").alias("id"), "text")
    sets = scratch.save(texts.mapInArrow(_multisets(width), "id long, elements binary, counts binary"), f"{name}-sets")
    side = lambda x: sets.select(F.col("id").alias(x), F.col("elements").alias(f"e{x}"), F.col("counts").alias(f"c{x}"))
    # A star's pairs share their centre: it is copied, so that they are not joined in one task.
    n = pairs.count()
    both = hot_join(hot_join(pairs, side("b"), "b", "a", pairs, n), side("a"), "a", "b", pairs, n).select("a", "b", "ea", "ca", "eb", "cb")
    out = scratch.save(both.mapInArrow(_verify(threshold), "a long, b long"), name)
    scratch.drop(f"{name}-sets", f"{name}-ids")
    return out
