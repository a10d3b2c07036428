"""Quality rules: base counts and robust multivariate outliers.

A document fails when it breaks a base rule, or when its vector of transformed statistics lies far from
the minimum-covariance-determinant (MCD) estimate of its language and source. The estimate is found by
concentration steps that are plain Spark aggregations: each step takes, in every group, the share ``h`` of
vectors nearest to the present centre, and re-estimates mean and covariance from them. Equal vectors of a group
count once, so that copies of one text are not taken for the bulk of it. No group is ever gathered in one task;
what a step keeps is one row of moments per group.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.llm.common import Scratch

N_STATS = 5
#: Median of the chi-square distribution with N_STATS degrees of freedom (fixed value).
CHI2_MEDIAN = 4.351460191095526
SYMBOLS = b"#*$%&|<>"
PUNCTUATION = b".,!?:;"
#: Letters that may be capitals.
_LETTERS = re.compile(r"[^\W\d_a-z]")
_PAIRS = [(i, j) for i in range(N_STATS) for j in range(i, N_STATS)]
BASE_SCHEMA = (
    "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, " + ", ".join(f"f{i} double" for i in range(N_STATS))
)


def repeat_words(words: list[bytes], width: int = 8) -> int:
    """Words inside windows of `width` (a power of two) words that occur twice or more, first occurrence included.

    Ranks of single words are doubled to ranks of 2, 4, 8 words, so equal ranks mean equal windows exactly.
    """
    n = len(words)
    if n < width + 1:
        return 0
    index: dict[bytes, int] = {}
    rank = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    if len(index) == n:
        return 0
    span = 1
    while span < width:
        rank = np.unique(rank[: len(rank) - span] * (n + 1) + rank[span:], return_inverse=True)[1].ravel()
        span *= 2
    hit = np.bincount(rank)[rank] > 1
    if not hit.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int, list[bytes]]:
    """(words, code points in words, symbols, repeated lines, words in repeated windows, the words)."""
    raw = (text or "").encode()
    words = raw.split()  # bytes.split() parts at exactly \x20 and \x09-\x0D
    chars = len(text or "") - (len(raw) - sum(map(len, words)))
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), dup, repeat_words(words), words


def statistics(text: str | None, counts: tuple) -> list[float] | None:
    """Transformed statistics, drawn to usual values in short texts by pseudo-counts: log word length, log symbol
    density, log capital density, log-ratio of distinct words to words, log punctuation per word. None: no word."""
    n, chars, symbols, _, _, words = counts
    if not n:
        return None
    raw = text.encode()
    capitals = sum(map(str.isupper, _LETTERS.findall(text)))
    marks = len(raw) - len(raw.translate(None, PUNCTUATION))
    return [
        math.log((chars + 200) / (n + 40)),
        math.log1p(100 * symbols / (chars + 500)),
        math.log((capitals + 5) / (chars + 250)),
        math.log(len(set(words)) + 50) / math.log(n + 50),
        math.log((marks + 3) / (n + 20)),
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in BASE_SCHEMA.split(", ")]
    for batch in batches:
        out: list[tuple] = []
        for i, lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts = base_counts(text)
            stats = statistics(text, counts) or [None] * N_STATS
            out.append((i, lang, source, *counts[:5], *stats))
        columns = list(zip(*out, strict=True)) if out else [()] * len(names)
        kinds = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 5, *[pa.float64()] * N_STATS]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _distance() -> Column:
    """Squared Mahalanobis distance from the columns m* (centre) and p* (inverse covariance, upper triangle)."""
    x = [F.col(f"f{i}") - F.col(f"m{i}") for i in range(N_STATS)]
    terms = [x[i] * x[j] * F.col(f"p{i}{j}") * (1.0 if i == j else 2.0) for i, j in _PAIRS]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def _invert(floor: float):
    """Per group: moments to centre, inverse covariance and log determinant."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = []
            for r in df.to_dict("records"):
                mean = np.array([r[f"s{i}"] for i in range(N_STATS)]) / r["n"]
                cov = np.zeros((N_STATS, N_STATS))
                for i, j in _PAIRS:
                    cov[i, j] = cov[j, i] = r[f"s{i}{j}"] / r["n"] - mean[i] * mean[j]
                # A statistic that hardly varies (symbols in clean prose) must not make the matrix singular.
                values, vectors = np.linalg.eigh(cov)
                values = np.maximum(values, 0) + floor
                inverse = (vectors / values) @ vectors.T
                rows.append(
                    {"g1": r["g1"], "g2": r["g2"], "logdet": float(np.log(values).sum())}
                    | {f"m{i}": mean[i] for i in range(N_STATS)}
                    | {f"p{i}{j}": inverse[i, j] for i, j in _PAIRS}
                )
            columns = ["g1", "g2", "logdet", *(f"m{i}" for i in range(N_STATS)), *(f"p{i}{j}" for i, j in _PAIRS)]
            yield pd.DataFrame(rows, columns=columns)

    return run


_PARAMS = "g1 string, g2 string, logdet double, " + ", ".join(
    [f"m{i} double" for i in range(N_STATS)] + [f"p{i}{j} double" for i, j in _PAIRS]
)


def _moments(rows: DataFrame) -> DataFrame:
    sums = [F.sum(f"f{i}").alias(f"s{i}") for i in range(N_STATS)]
    sums += [F.sum(F.col(f"f{i}") * F.col(f"f{j}")).alias(f"s{i}{j}") for i, j in _PAIRS]
    return rows.groupBy("g1", "g2").agg(F.count("*").alias("n"), *sums)


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    h: float = 0.75,
    cutoff: float = 10.0,
    floor: float = 4e-4,
    min_group: int = 50,
    max_steps: int = 40,
    tolerance: float = 0.01,
    broadcast_groups: int = 50_000,
    min_words: int = 20,
    repeat_percent: int = 30,
) -> DataFrame:
    """One row per document: base counts, base_failed, robust distance, kept, settled.

    h: share of a group's different vectors that the estimate rests on. cutoff: largest distance kept, in robust
    standard deviations; at 10 only gross outliers go. floor: variance added on every axis. min_group: a language
    and source with fewer different vectors is estimated with the language's other small groups, and if those are
    too few with all such rows; below that no distance is known and the base rules decide alone. settled: did the
    estimate of the document's group stop moving within max_steps (null without an estimate)?

    Null language or source is a group of its own; null or wordless text counts 0 words and fails; repeated
    rows and repeated ids each give their row; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality-rules")
    picked = docs.select(F.col(id_col).cast("long"), F.col(lang_col).cast("string"), F.col(source_col).cast("string"), F.col(text_col).cast("string"))
    base = scratch.save(picked.mapInArrow(_measure, BASE_SCHEMA), "base")

    # The group that each language and source is estimated in.
    vector = [f"f{i}" for i in range(N_STATS)]
    distinct = scratch.save(base.filter("f0 is not null").select("lang", "source", *vector).distinct(), "distinct")
    sizes = distinct.groupBy("lang", "source").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("own", F.col("n") >= min_group)
    pooled = sizes.filter("not own").groupBy("lang").agg(F.sum("n").alias("pool"))
    text = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))  # noqa: E731  null and "" stay apart
    groups = sizes.join(pooled.withColumnRenamed("lang", "pl"), F.col("lang").eqNullSafe(F.col("pl")), "left").select(
        text(F.col("lang")).alias("k1"),
        text(F.col("source")).alias("k2"),
        F.when(F.col("own") | (F.col("pool") >= min_group), text(F.col("lang"))).otherwise("*").alias("g1"),
        F.when(F.col("own"), text(F.col("source"))).otherwise("*").alias("g2"),
    )
    groups = scratch.save(groups, "groups")
    small = F.broadcast if groups.count() <= broadcast_groups else lambda df: df
    grouped = lambda df: df.withColumns({"k1": text(F.col("lang")), "k2": text(F.col("source"))}).join(small(groups), ["k1", "k2"], "left")
    rows = scratch.save(grouped(base).drop("k1", "k2"), "rows")
    stats = scratch.save(grouped(distinct).select("g1", "g2", *vector).distinct(), "stats")

    # Start: coordinatewise medians and scales; then concentration steps until no determinant falls any more.
    mid = stats.groupBy("g1", "g2").agg(*(F.percentile_approx(f"f{i}", [0.25, 0.5, 0.75], 2000).alias(f"q{i}") for i in range(N_STATS)))
    start = [F.col(f"q{i}")[1].alias(f"m{i}") for i in range(N_STATS)]
    spread = lambda i: F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) + floor
    start += [(1 / spread(i) if i == j else F.lit(0.0)).alias(f"p{i}{j}") for i, j in _PAIRS]
    params = scratch.save(mid.select("g1", "g2", F.lit(None).cast("double").alias("logdet"), *start), "params0")
    for step in range(1, max_steps + 1):
        near = stats.join(small(params), ["g1", "g2"]).withColumn("d2", _distance())
        limit = near.groupBy("g1", "g2").agg(F.percentile_approx("d2", h, 2000).alias("limit"))
        half = near.join(small(limit), ["g1", "g2"]).filter("d2 <= limit")
        now = scratch.save(_moments(half).mapInPandas(_invert(floor), _PARAMS), f"params{step}")
        was = params.select("g1", "g2", F.col("logdet").alias("old"))
        moved = now.join(was, ["g1", "g2"]).filter(F.coalesce(F.abs(F.col("logdet") - F.col("old")) > tolerance, F.lit(True)))
        params = now
        moving = scratch.save(moved.select("g1", "g2", F.lit(False).alias("settled")), f"moving{step}")
        if moving.isEmpty():
            break

    # Scale so that the median squared distance is that of a normal sample.
    scale = stats.join(small(params), ["g1", "g2"]).withColumn("d2", _distance())
    scale = scale.groupBy("g1", "g2").agg(F.percentile_approx("d2", 0.5, 2000).alias("median"), F.count("*").alias("members"))
    final = params.join(scale, ["g1", "g2"]).join(moving, ["g1", "g2"], "left").withColumn("settled", F.coalesce("settled", F.lit(True)))
    final = scratch.save(final, "final")
    judged = rows.join(small(final), ["g1", "g2"], "left")
    known = F.col("members") >= min_group
    distance = F.when(known, F.sqrt(F.greatest(_distance(), F.lit(0.0)) * CHI2_MEDIAN / F.greatest("median", F.lit(1e-12))))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    out = judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & F.coalesce(distance <= cutoff, F.lit(True))).alias("kept"),
        distance.alias("robust_distance"), "settled",
    )
    return scratch.last(out)
