"""Queries of this subpackage over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlytics.llm import (bwt_dedup, exact_dedup, license_scan, lm_score, ngram_join, packing, permutation_index,
                             quality, ranked_search, rtree_negatives, scratch, sentencepiece_codec, substring_dedup,
                             toxicity)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the ids, and whether they decode to the text again."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = _table(spark, sf_dir, "documents")
    ids = sentencepiece_codec.encode(docs.select("doc_id", "text"), path)
    back = sentencepiece_codec.decode(ids, path, ["doc_id", "n_tokens", "ids"])
    return back.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"),
                       F.length("text").cast("long").alias("decoded_chars"), F.crc32("text").alias("decoded_crc32"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of directories <source>/<doc_id div 1000>/<doc_id div 100>,
    of which the first id stands for the licence file."""
    docs = _table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 100 == 0, "LICENSE").when(F.col("doc_id") % 1000 == 1, "../LICENSE").otherwise(
        F.col("doc_id").cast("string"))
    folder = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000).cast("string"))
    path = F.when(name == "../LICENSE", F.concat(folder, F.lit("/LICENSE"))).otherwise(
        F.concat_ws("/", folder, F.floor(F.col("doc_id") / 100).cast("string"), name))
    return license_scan.scan(docs, path)


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return permutation_index.nearest(rows, F.col("vec_id") % 20 == 0)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against conversations, the target, and all documents."""
    docs = _table(spark, sf_dir, "documents")
    return lm_score.cross_entropy_difference(docs, _table(spark, sf_dir, "conversations"), docs)


def fold(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), fold(3) != 1)
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), fold(5) != 0)
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.token_pieces(_table(spark, sf_dir, "documents"), path)
    pieces = scratch.table(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packing.pack(pieces)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh id are moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rtree_negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=moved)


def op13_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is left of each document."""
    cut = bwt_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm
           FROM documents),
     g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM n JOIN g USING (norm)
"""

OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
     i AS (SELECT row_number() OVER () AS i, item_id,
                  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark),
     c AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d WHERE len(terms) > 0),
     m AS (SELECT r, doc_id, 25 + (75 * len(terms) * docs) // total AS m FROM d, c WHERE len(terms) > 0),
     p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
     w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w
           FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
     q AS (SELECT i, term, count(*) AS times FROM (SELECT i, unnest(terms) AS term FROM i) GROUP BY i, term),
     s AS (SELECT i, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
           FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY i, r),
     k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
                  doc_id, score
           FROM s JOIN m USING (r) JOIN (SELECT i, item_id FROM i) USING (i) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
OP12_SQL = r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
                  CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
           FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
     p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
           QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
     n AS (SELECT anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score,
                  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank
           FROM p JOIN s USING (anchor_id)
           WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

# Bytes are pairs of hexadecimal digits here.
OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
     g AS (SELECT r, doc_id, p, substr(h, 2 * p + 1, 100) AS s
           FROM (SELECT r, doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM d WHERE len(h) >= 100)),
     m AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s HAVING count(*) > 1),
     hit AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM g JOIN m USING (s) WHERE least < doc_id),
     run AS (SELECT r, min(p) AS a, max(p) + 50 AS b
             FROM (SELECT r, p, sum(CASE WHEN p <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS k FROM hit)
             GROUP BY r, k),
     part AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS last_b FROM run),
     cut AS (SELECT r, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed, max(b) AS tail,
                    string_agg(substr(h, 2 * last_b + 1, 2 * (a - last_b)), '' ORDER BY a) AS head
             FROM part JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_lm_score, op3_toxicity, op4_exact_dedup, op5_best_fit_packing,
                                   op6_ngram_join, op7_quality, op8_nearest, op9_substring_dedup, op10_license_scan, op11_ranked_search,
                                   op12_hard_negatives, op13_bwt_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4_SQL, "op11_ranked_search": OP11_SQL, "op12_hard_negatives": OP12_SQL,
            "op13_bwt_dedup": OP13_SQL}
