"""The corpus pipeline: five stages from raw documents to packed training rows.

Each stage takes the rows that the one before kept. All but the last return the columns of documents; the last
returns the packing of the kept texts.
"""

from __future__ import annotations

from contextvars import ContextVar

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.llm.common import Scratch, table
from driftmark.llm.minhash import near_duplicates
from driftmark.llm.packing import pack_documents
from driftmark.llm.quality_rules import quality_rules
from driftmark.llm.ranker import fit, score
from driftmark.llm.substring_dedup import cut_text, repeated_spans

#: A path to a tokenizer file; packing writes its tokens.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Bytes of the shortest passage that is cut where it repeats: fifty words of four letters and a space. A passage of over fifty
#: words is found whole, between whatever texts it stands, unless its words have under four letters on average.
PASSAGE = 250


#: Where the stages of the present run number their rows.
_ROWS: ContextVar[Scratch | None] = ContextVar("rows", default=None)


def _numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with a key of each row's own in _row, written: doc_id may be null or repeated, so it tells no rows apart.

    In run() they go when the stage's result is written; those of a stage called by itself, which its lazy result reads,
    when the driver ends.
    """
    scratch = _ROWS.get() or Scratch(spark, "pipeline-rows")
    return scratch.save(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a hash of all that a stage judges a row by in _row. Rows that share it share the verdict, so that nothing
    need be numbered and written; unlike rows share one by chance only (64 bits)."""
    read = ("doc_id", "lang", "source", "text")
    return docs.withColumn("_row", F.xxhash64(*read, *(F.col(c).isNull() for c in read)))


def _keep(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The numbered rows whose _row is in kept(id), without that column."""
    return rows.join(kept, rows["_row"] == kept["id"], "left_semi").drop("_row")


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _keyed(docs)
    return _keep(rows, quality_rules(rows, id_col="_row").filter("kept").select(F.col("doc_id").alias("id")))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model is fitted on labelled rows of the whole table: the rules before have removed most of label 0."""
    model = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    rows = _keyed(docs)
    return _keep(rows, score(rows, model, id_col="_row").filter("predicted = 1").select(F.col("doc_id").alias("id")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, the one with the smallest doc_id, null ids last; documents without words stay."""
    rows = _numbered(spark, docs)
    classes = near_duplicates(rows, id_col="_row").select(F.col("doc_id").alias("_row"), "class_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))
    kept = rows.select("_row", "doc_id").join(classes, "_row").groupBy("class_id").agg(first.alias("first"))
    return _keep(rows, kept.select(F.col("first._row").alias("id")))


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of the texts; n_chars follows. Every document stays, if with an empty text. What is cut
    belongs to an id and a text, so rows without an id or with another's keep their own."""
    return cut_text(docs, repeated_spans(docs, length=PASSAGE))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text have nothing to pack."""
    texts = docs.filter(F.length("text") > 0)
    return pack_documents(texts, TOKENIZER)


STAGES = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", quality_classifier_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("suffix-array dedup", suffix_dedup_stage),
    ("best-fit packing", packing_stage),
]

#: Robust estimates, ranking and signatures have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        rows = Scratch(spark, "pipeline-rows")
        before = _ROWS.set(rows)
        try:
            docs = scratch.save(stage(spark, docs, sf_dir), f"stage{number}")
        finally:
            _ROWS.reset(before)
            rows.drop_all()
        scratch.drop(f"stage{number - 1}")
    return docs
