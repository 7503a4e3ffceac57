"""The queries of the ten operators over the whole table documents, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, fingerprints, jaccard_join, licenses, packing, pii, quality, shared, sharding, substring_dedup, token_counts

docs = shared.documents


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table arrives in two batches, as a corpus grows: the cache starts empty, gets the English documents' counts, and has them when the whole table is counted. Each distinct text is encoded once."""
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), shared.scratch(spark, "token-counts")
    token_counts.token_counts(docs(spark, sf_dir).filter("lang = 'en'"), path, cache)
    out = token_counts.token_counts(docs(spark, sf_dir), path, cache)
    return out.withColumn("over_limit", F.col("n_tokens") > 512)


def op2_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(docs(spark, sf_dir), size=None)


def op3_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonyms(docs(spark, sf_dir), pii.DEMO_KEY)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(docs(spark, sf_dir))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encoded(docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_classes(docs(spark, sf_dir), n=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(docs(spark, sf_dir), [1.0] * 24)


def op9_suffix_array_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(docs(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.without_repeats(docs(spark, sf_dir).select("doc_id", "text"))
    kept = F.when(F.col("__cairn_n_removed") > 0, F.col("__cairn_left")).otherwise(substring_dedup.single_spaced(F.col("__cairn_left")))
    return out.select("doc_id", F.col("__cairn_n_words").alias("n_words"), F.col("__cairn_n_removed").alias("n_removed"), F.sha2(kept, 256).alias("kept_sha256"))


def queries() -> dict:
    own = [op1_token_counts, op2_syncmer_fingerprints, op3_feistel_pseudonyms, op4_license_scan, op5_bpe_codec, op6_jaccard_join, op7_best_fit_packing, op8_rendezvous_shards, op9_suffix_array_quality, op10_substring_dedup]
    return {f.__name__: f for f in own}


#: White space and words as the contracts have them, for DuckDB.
_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _lower(x: str) -> str:
    return _LOWER.format(x)


def oracle_sql() -> dict[str, str]:
    op6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_lower("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
n AS (SELECT d.doc_id, count(g) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2"""
    op10 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM p JOIN d USING (doc_id) WHERE i + 19 <= len(w)),
t AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM t WHERE k > 1),
k AS (SELECT p.doc_id, string_agg(w[p.i], ' ' ORDER BY p.i) AS kept, count(*) AS n FROM p JOIN d USING (doc_id) ANTI JOIN c ON c.doc_id = p.doc_id AND c.i = p.i GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
    return {"op6_jaccard_join": op6, "op8_rendezvous_shards": sharding.SQL, "op10_substring_dedup": op10}
