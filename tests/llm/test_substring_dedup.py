"""Substring dedup against a brute-force version."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from driftmark.llm import substring_dedup as S

SCHEMA = "doc_id long, text string, k1 string, n_removed string"


def brute(docs, length):
    count = Counter()
    raws = [(i, (t or "").encode()) for i, t in docs]
    for _, raw in raws:
        count.update(raw[p : p + length] for p in range(len(raw) - length + 1))
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if count[raw[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for p in range(len(raw)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, docs, length):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], SCHEMA)
    got = S.repeated_spans(df, length=length, per_bucket=50).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    return sorted(map(tuple, got), key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = ["ab", "cde", "é", "fghij", "k"]
    prose = lambda n: " ".join("".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(n))
    shared = [prose(60) for _ in range(4)]
    docs = []
    for i in range(40):
        parts = [prose(rng.randint(0, 40)) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            parts.insert(rng.randint(0, 3), s[a : a + rng.randint(30, 300)])
        docs.append((i, " ".join(parts)))
    docs += [(100, None), (101, ""), (102, "x" * 500), (103, "Thaen " * 60), (104, docs[3][1]), (105, docs[3][1]), (5, docs[5][1]), (None, docs[6][1]), (106, "y" * 79), (107, "z" * 80)]
    docs += [(108, "q" * 81)]
    assert run(spark, docs, 80) == brute(docs, 80)


def test_pieces_of_long_texts(spark, monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choices("abc", k=3000))
    docs = [(0, text), (1, text[500:900] + "x" + text[1400:2600]), (2, text[700:1500])]
    want = brute(docs, 120)
    monkeypatch.setattr(S, "PIECE", 1024)
    raw = np.frombuffer(text.encode(), np.uint8)
    first, n = S.runs(raw, 120)[:2]
    assert sorted(np.concatenate([np.arange(a, a + b) for a, b in zip(first, n)])) == list(range(len(text) - 119))
    monkeypatch.undo()
    assert run(spark, docs, 120) == want


def test_empty_table(spark):
    assert run(spark, [], 400) == []


def test_multikey_quicksort():
    rng = random.Random(0)
    strings = ["".join(rng.choices("ab", k=rng.randint(0, 30))).encode() for _ in range(3000)] + [b"a\0", b"a", b"a\0\0"] * 50 + [b"x" * 40] * 500
    order = S.multikey_quicksort(strings, small=16)
    assert [strings[i] for i in order] == sorted(strings) and sorted(order) == list(range(len(strings)))


def test_equal_hashes_alone_remove_nothing(spark, monkeypatch):
    """What the narrowing chooses is a guess: only equal bytes count."""
    rng = random.Random(9)
    docs = [(i, "".join(rng.choices("abcdefgh ", k=400))) for i in range(6)]
    rows = [(0, i, 0, 321, t) for i, t in docs]
    units = spark.createDataFrame(rows, "k1 long, k2 long, first long, n long, text string")
    lists = units.selectExpr("k1", "k2", "text", "1 as times", "array(first)", "array(n)")
    found = lists.mapInArrow(S._suffix_rows(80), S._UNITS).selectExpr("*", "xxhash64(suffix) as hash").repartition(1).mapInArrow(S._sort_bucket, S._SORTED).collect()
    assert not any(r["hit"] for r in found) and sum(r["edge"] for r in found) == 2


def test_cut_text_keeps_rows_of_one_id_apart(spark):
    rng = random.Random(21)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))
    passage = prose(60)
    docs = [(None, prose(90)), (None, passage + " tail é"), (1, prose(40) + passage), (1, prose(80)), (1, None), (2, ""), (3, passage), (3, passage)]
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in docs], "doc_id long, text string, n_chars int")
    got = S.cut_text(df, S.repeated_spans(df, length=200))
    want = []
    for i, t in docs:
        kept = t if t is None or passage not in t else t.replace(passage, "")
        want.append((i, kept, len(t or "") if kept == t else len(kept)))
    # A passage's neighbours may repeat by chance with it, so compare without white space at the cuts.
    squeezed = lambda rows: sorted(((i, t and t.strip(), n - len(t or "") + len((t or "").strip())) for i, t, n in rows), key=str)
    assert got.columns == df.columns and squeezed(map(tuple, got.collect())) == squeezed(want)


@pytest.fixture
def partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("n,head", [(1, "Copyright (c) 2020 "), (16, "é" * 12 + " common head "), (200, "Copyright (c) 2020 ")])
def test_twins_behind_a_common_beginning(spark, partitions, n, head):
    """Texts that share their first bytes, each held by two documents, whatever the number of buckets."""
    rng = random.Random(31)
    texts = []
    for _ in range(60):
        text = head + "".join(rng.choices("abcdefgh ", k=400))
        texts.append(text.encode()[:400].decode(errors="ignore") + "x")
    docs = [(2 * i + k, t) for i, t in enumerate(texts) for k in (0, 1)]
    docs += [(1000 + i, head + "".join(rng.choices("abcdefgh ", k=rng.randint(300, 700)))) for i in range(100)]
    partitions(n)
    assert run(spark, docs, 300) == brute(docs, 300)


@pytest.mark.parametrize("n", [16, 100])
def test_one_suffix_over_many_buckets(spark, partitions, n):
    """One string held by a third of the documents, beside twins that share its beginning."""
    rng = random.Random(33)
    head = "a common header of all the texts "
    hot = head + "".join(rng.choices("abcd ", k=200))
    twins = [head + "".join(rng.choices("abcd ", k=200)) for _ in range(30)]
    docs = [(i, hot + f" {i}") for i in range(60)] + [(100 + 2 * i + k, t + f" {k}") for i, t in enumerate(twins) for k in (0, 1)]
    docs += [(1000 + i, head + "".join(rng.choices("efgh ", k=200))) for i in range(60)]
    partitions(n)
    assert run(spark, docs, 150) == brute(docs, 150)
