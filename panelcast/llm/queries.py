"""The registered queries of this subpackage, with production parameters, and
their DuckDB SQL where SQL can express them on whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import bpe, decontam, licenses, line_dedup, minhash, packing, quality, sharding, spelling, substrings, topk, toxicity, whitening
from panelcast.llm.common import read

#: Eight shards in two regions of two racks.  The ninth comes as a region of
#: its own, so every row that moves moves into it.
TREE = tuple(sharding.Shard(f"region{s // 4}", f"rack{s // 2 % 2}", s) for s in range(8))
GROWN = (*TREE, sharding.Shard("region2", "rack0", 8))
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
WORD_PIECES = "word_bpe_49k.json"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of source trees: directory source/thousands/hundreds
    of the doc_id; texts whose first line names a licence play licence files."""
    docs = read(spark, sf_dir, "documents")
    name = F.when(F.col("text").rlike(r"(?i)\A[^\n]*licen[cs]e"), F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.concat("doc_id", F.lit(".txt")))
    path = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000), F.floor(F.col("doc_id") / 100), name)
    return licenses.scan(docs.select("doc_id", path.alias("path"), "text"), carry=["doc_id"])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.without_repeated_lines(read(spark, sf_dir, "documents"), sketch=line_dedup.SKETCH)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    return sharding.sharded(docs, "doc_id", TREE, grown=GROWN, carry=["size", "text_crc32", "law"])


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.without_repeats(read(spark, sf_dir, "documents"), min_words=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path(VOCABULARY))
    out = bpe.decoded(bpe.encoded(docs, ranks, public_tokenizers.PATTERN), ranks)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=2, similarity=80)


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), k=5, every=50)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"), min_length=7, min_count=2, factor=10, every=31)


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_PIECES), capacity=4096, end_id=1,
                          keep=[F.crc32("ids").alias("ids_crc32")])


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read(spark, sf_dir, "embeddings"), k=16, scale=64.0)


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_line_dedup, op3_sharding, op4_substring_dedup, op5_quality_classifier,
    op6_bpe, op7_minhash_dedup, op8_exact_topk, op9_toxicity, op10_decontamination,
    op11_spelling_variants, op12_best_fit_packing, op13_embedding_whitening)}

ORACLE = {
    "op8_exact_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS rid, vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (
            SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.rid <> c.rid AND len(q.v) = len(c.v)),
        r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op4_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        g AS (
            SELECT doc_id, unnest(range(1, greatest(len(w) - 11, 1))) AS i, w FROM w),
        h AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM g),
        m AS (SELECT s, min(doc_id) AS d FROM h GROUP BY s HAVING min(doc_id) < max(doc_id)),
        c AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM h JOIN m USING (s) WHERE doc_id > d),
        p AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
        k AS (
            SELECT p.doc_id, count(*) AS n_words, count(c.i) AS n_removed,
                   coalesce(string_agg(x, ' ' ORDER BY p.i) FILTER (WHERE c.i IS NULL), '') AS kept
            FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.i = p.i GROUP BY p.doc_id)
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM documents d LEFT JOIN k USING (doc_id)""",
}
