"""Token counts against the libraries."""

import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from driftmark.llm import token_counts as T

FILES = ["piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.json"]


def library(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text))
    model = Tokenizer.from_file(path)
    return lambda text: len(model.encode(text, add_special_tokens=False).ids)


def texts():
    rng = random.Random(4)
    bits = ["word", "Über", "straße", "中文字", "é", "é", "́", "▁", "don't", "<s>", "<|endoftext|>", "12,345", "...", "\x1c", " ", "　", "\0", "aaaaaaaa", "I'll"]
    gaps = [" ", " ", " ", "  ", "\n", "\t", "", " \n ", "▁"]
    made = ["".join(rng.choice(bits) + rng.choice(gaps) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    return made + ["", " ", "x", " lead and trail ", "no" * 3000, "a b " * 2000]


@pytest.mark.parametrize("name", FILES)
def test_parts_add_up(name):
    """Split anywhere it is allowed, the parts have the text's tokens."""
    want, counter = library(name), T.lengths(public_tokenizers.path(name))
    assert counter.splits
    for text in texts():
        for most in (1, 7, 50):
            cut = T.parts(text, counter, most)
            assert sum(counter.count(cut)) == want(text)
    assert len(T.parts("one two three", counter, 1)) == 3


@pytest.mark.parametrize("name", FILES[:2])
def test_counts_are_the_library_s(spark, name):
    want = library(name)
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())]
    rows += [(None, "lost id", "x", 1), (7, "other text of an id", "x", 1), (8, "twin row", "x", 1), (8, "twin row", "x", 1), (9, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, row int").repartition(3)
    wanted = sorted([(i, len((t or "").encode()), n := want(t or ""), n > 900) for i, t, _, _ in rows], key=str)
    path = public_tokenizers.path(name)
    got = T.token_counts(df, path, limit=900)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.collect()), key=str) == wanted
    # Long texts dealt part by part give the same.
    assert sorted(map(tuple, T.token_counts(df, path, limit=900, dealt=300).collect()), key=str) == wanted
    assert T.token_counts(df.limit(0), path).count() == 0


def test_counts_of_the_test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = library(FILES[0])
    got = {r["doc_id"]: r["n_tokens"] for r in T.token_counts(docs, public_tokenizers.path(FILES[0])).collect()}
    assert got == {r["doc_id"]: want(r["text"] or "") for r in docs.collect()}
