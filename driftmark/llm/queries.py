"""The registered queries of the corpus operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from driftmark.llm.common import table
from driftmark.llm.embed_lsh import lattice_duplicates
from driftmark.llm.license_scan import license_scan
from driftmark.llm.minhash import near_duplicates
from driftmark.llm.periodic import periodic_runs, planted, run_digest
from driftmark.llm.quality_rules import quality_rules
from driftmark.llm.packing import pack_documents
from driftmark.llm.ranker import fit, score
from driftmark.llm.sp_fst import encoding_digest
from driftmark.llm.substring_dedup import repeated_spans
from driftmark.llm.token_counts import token_counts
from driftmark.llm.token_store import token_file_digest
from driftmark.llm.whitening import whiten
from driftmark.llm.wrapper import extract_main_text


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op5_lattice_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_duplicates(table(spark, sf_dir, "embeddings"), least=0.93)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"), length=400).drop("starts", "ends", "text_hash")


def op7_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=1)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), scale=256, components=4)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(periodic_runs(planted(table(spark, sf_dir, "documents")), least=24, exponent=3))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [v for k, v in globals().items() if k.startswith("op") and callable(v)]
    return {f.__name__: f for f in found}


#: Every pair that shares a shingle, on whole multisets; components by reachability.
_OP2 = """WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM t WHERE len(w) > 0),
c AS MATERIALIZED (SELECT doc_id, hash(s) AS s, count(*) AS n FROM s GROUP BY ALL),
sets AS MATERIALIZED (SELECT doc_id, sum(n) AS size, list({'s': s, 'n': n} ORDER BY s) AS k FROM c GROUP BY doc_id),
reps AS MATERIALIZED (SELECT doc_id, size, min(doc_id) OVER (PARTITION BY hash(k)) AS rep FROM sets),
rc AS MATERIALIZED (SELECT c.* FROM c JOIN reps USING (doc_id) WHERE doc_id = rep),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS shared FROM rc a JOIN rc b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM met JOIN reps x ON x.doc_id = a JOIN reps y ON y.doc_id = b WHERE shared >= 0.8 * (x.size + y.size - shared) - 1e-9),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT rep, rep FROM reps WHERE doc_id = rep UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS rep, min(b) AS class_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(class_id = d.doc_id, true) AS kept FROM documents d LEFT JOIN reps USING (doc_id) LEFT JOIN m USING (rep)"""

#: Every 400-byte window of every text, as hexadecimal digits.
_OP6 = """WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, unnest(range(octet_length(encode(x)) // 2 - 399)) AS p, x FROM d WHERE length(x) >= 800),
h AS (SELECT r, p, hash(substr(x, 2 * p + 1, 800)) AS h FROM w),
hit AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY h) AS c FROM h) WHERE c > 1),
runs AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM hit),
marks AS (SELECT r, p, sum(CASE WHEN before IS NULL OR p - before > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS span FROM runs),
spans AS (SELECT r, span, min(p) AS a, max(p) + 400 AS z FROM marks GROUP BY r, span),
g AS (SELECT r, list({'a': a, 'z': z} ORDER BY a) AS s, sum(z - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
 sha256(unhex(CASE WHEN s IS NULL THEN x ELSE list_reduce(list_prepend(substr(x, 1, 2 * s[1].a), list_transform(range(1, len(s) + 1), lambda i: substr(x, 2 * s[i].z + 1, 2 * (coalesce(s[i + 1].a, length(x) // 2) - s[i].z)))), lambda a, b: a || b) END)) AS kept_sha256
FROM d LEFT JOIN g USING (r)"""

#: Links by all pairs, components by reachability.
_OP5 = """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL),
l AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a), d AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(d.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN d USING (vec_id)"""


def oracle_sql() -> dict[str, str]:
    """The other operators have no form in SQL; tests hold them against brute force, exact round trips or held-out labels."""
    return {"op2_near_duplicates": _OP2, "op5_lattice_duplicates": _OP5, "op6_suffix_dedup": _OP6}
