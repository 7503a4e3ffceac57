"""Operator 8: weighted rendezvous hashing of stable record keys [native].

Each key scores every shard by -weight / ln(u) with u in (0, 1) from an MD5 of key and shard number,
and goes to the shard with the highest score. Scores of existing shards don't depend on how many
there are, so one more shard only takes rows.

Defined cases: a null key is a key of its own; rows with equal keys share a shard; a null text has
size 8 and the CRC of an empty text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared


def score(key: Column, shard: int, weight: float) -> Column:
    said = F.md5(F.concat(key, F.lit(f"/{shard}")))
    u = (F.conv(F.substring(said, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return F.lit(-float(weight)) / F.log(u)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The number of the shard, from 0, that `key` (any type) goes to."""
    key = F.coalesce(key.cast("string"), F.lit("null"))
    best = F.array_max(F.array(*[F.struct(score(key, s, w).alias("score"), F.lit(-s).alias("shard")) for s, w in enumerate(weights)]))
    return (-best["shard"]).cast("int")


def sharded(docs: DataFrame, weights: list[float], grown: list[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place in the shard, from 0), grown_shard (with the weights `grown`)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col("doc_id"), weights).alias("shard"),
        rendezvous(F.col("doc_id"), grown or [*weights, weights[-1]]).alias("grown_shard"),
    )
    bucket = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, 2)
    out = shared.ranked(rows, "shard", bucket, ["doc_id", "text_crc32", "size"], "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: The query's result in DuckDB's SQL, for 24 equal shards.
SQL = """
WITH s AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, 'null') AS k FROM documents),
t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs),
b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM s),
r AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, crcs[xor(c & 255, x) + 1])), 4294967295) AS crc FROM b, t),
c AS (SELECT doc_id, k, n, -1.0 / ln((('0x' || substr(md5(k || '/' || n), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0) AS score
      FROM s, range(25) t(n)),
p AS (SELECT doc_id, max_by(n, score) FILTER (n < 24) AS shard, max_by(n, score) AS grown FROM c GROUP BY doc_id)
SELECT doc_id, (strlen(text) + 8)::BIGINT AS size, crc AS text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY substr(md5(k), 1, 2), doc_id) - 1 AS slot, grown::INT AS grown_shard
FROM s JOIN p USING (doc_id) JOIN r USING (doc_id)
"""
