"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from driftmark.llm import periodic as P


def plain_lyndon(x):
    """Longest Lyndon word from each place: up to the next smaller suffix."""
    n = len(x)
    return [next((j for j in range(i + 1, n) if x[j:] < x[i:]), n) - i for i in range(n)]


def test_lyndon_lengths_against_suffixes():
    rng = random.Random(1)
    for letters in (1, 2, 3, 8):
        for _ in range(300):
            x = [rng.randrange(letters) for _ in range(rng.randint(0, 40))]
            assert P.lyndon_lengths(x) == plain_lyndon(x)
    for x in ([1, 0] * 30, [0, 1] * 30 + [0], [0, 0, 1] * 20 + [0, 0], [2, 1, 0] * 15, [5] * 50):
        assert P.lyndon_lengths(x) == plain_lyndon(x)


def plain_runs(x, least, exponent):
    """All maximal stretches by trying each period; the smallest period of a stretch counts."""
    n, found = len(x), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            size = j + q - i
            if size >= max(least, exponent * q) and not any(all(x[k] == x[k + r] for k in range(i, i + size - r)) for r in range(1, q)):
                found.append((i, size, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def made(rng, n, letters):
    """Words with periods of several lengths, some nested and some side by side."""
    out = []
    while len(out) < n:
        root = [rng.choice(letters) for _ in range(rng.randint(1, 12))]
        if rng.random() < 0.3:
            root = root * rng.randint(2, 4) + [rng.choice(letters)]
        out += root * rng.randint(1, 9) + root[: rng.randint(0, len(root))]
    return out[:n]


def test_runs_against_all_periods():
    rng = random.Random(2)
    for letters in ("ab", "abc", "abcdefgh"):
        for _ in range(120):
            x = made(rng, rng.randint(0, 150), letters)
            ranks = np.array([ord(c) for c in x], np.int64)
            assert sorted(P.runs_of(ranks, 6, 2), key=lambda r: (r[0], r[2])) == plain_runs(x, 6, 2)
            assert sorted(P.runs_of(ranks, 24, 3), key=lambda r: (r[0], r[2])) == plain_runs(x, 24, 3)


def test_narrowed_texts_keep_all_runs():
    rng = random.Random(3)
    for letters in (["a", "bb"], ["x", "é", "中", "\x1c"], [f"w{i}" for i in range(30)]):
        for _ in range(150):
            words = made(rng, rng.randint(0, 160), letters)
            gap = rng.choice([" ", "\n", " \t"])
            raw = gap.join(words).encode()
            assert P.find_runs(raw, raw.split()) == plain_runs(words, 24, 3)
            assert P.find_runs(raw, raw.split(), 10, 4) == plain_runs(words, 10, 4)
            assert P.find_runs(raw, raw.split(), 20, 3) == plain_runs(words, 20, 3)


def test_hashes_that_agree_by_chance_are_mended(monkeypatch):
    monkeypatch.setattr(P.Extensions, "_hash", lambda self, at, size: at * 0)
    rng = random.Random(4)
    for _ in range(30):
        x = made(rng, 90, "ab")
        got = P.runs_of(np.array([ord(c) for c in x], np.int64), 24, 3)
        assert set(got) <= set(plain_runs(x, 24, 3))


def test_long_periodic_texts():
    raw = b"ab cd ef " * 30_000
    assert P.find_runs(raw, raw.split()) == [(0, 90_000, 3)]
    words = [f"w{i}".encode() for i in range(5000)] * 3
    assert P.find_runs(b" ".join(words), words) == [(0, 15_000, 5000)]
    words = words[:-1]
    assert P.find_runs(b" ".join(words), words) == []


def digest(doc_id, text):
    """The contract's row, in plain steps."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w, 24, 3)
    best = (None,) * 4
    for s, size, q in runs:
        if best[0] is None or size * best[2] > best[1] * q:
            best = (s, size, q, 1000 * size // q)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_digest_against_plain_steps(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(made(rng, rng.randint(0, 120), ["a", "b é", "c\n", "dd"]))) for i in range(300)]
    rows += [(None, "a b " * 40), (5, "other text of an id " * 9), (6, "twin " * 30), (6, "twin " * 30), (1000, None), (1001, ""), (1002, " \n "), (1003, "x"), (1004, "a b " * 3000)]
    planted = [i for i in range(2000, 2600) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows += [(i, t) for i, t in zip(planted, [None, "", " ", "one", "one two", *(" ".join(f"v{j}" for j in range(rng.randint(3, 200))) for _ in planted)])]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, w string, runs int, start int").repartition(3)
    got = P.run_digest(P.periodic_runs(P.planted(df)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((digest(i, t) for i, t in rows), key=str)
    assert P.periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        P.periodic_runs(df, exponent=2)


def test_texts_of_the_test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 6000")
    got = P.run_digest(P.periodic_runs(P.planted(docs))).collect()
    assert sorted(map(tuple, got)) == sorted(digest(r["doc_id"], r["text"]) for r in docs.collect())
    assert sum(r["n_runs"] > 0 for r in got) > 5
