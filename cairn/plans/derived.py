"""Catalog, range, chunk and log tables derived from the sample tables, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects: container is the language, name is source/id."""
    d = table(spark, sf_dir, "documents")
    name = F.concat_ws("/", "source", F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    created = F.timestamp_seconds(F.lit(1_600_000_000) + F.col("doc_id") * 3600)
    none = F.lit(None).cast("string")
    return d.select(
        F.col("lang").alias("container"), name.alias("name"), none.alias("version_id"), none.alias("snapshot"), F.concat(F.lit("g"), F.col("doc_id").cast("string")).alias("generation_id"),
        F.lit(True).alias("is_current"), (F.col("doc_id") % 17 == 3).alias("is_deleted"), (F.col("doc_id") % 40 == 7).alias("is_directory"),
        (F.col("n_chars") * 64).alias("length"), created.alias("created_at"), F.md5("text").alias("etag"), F.sha2("text", 256).alias("sha256"), "doc_id",
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("tags"),
    )


BLOBS = """blobs AS (SELECT lang AS container, source || '/' || lpad(doc_id::VARCHAR, 9, '0') AS name, NULL::VARCHAR AS version_id, NULL::VARCHAR AS snapshot,
  'g' || doc_id AS generation_id, true AS is_current, doc_id % 17 = 3 AS is_deleted, doc_id % 40 = 7 AS is_directory, n_chars * 64 AS length,
  make_timestamp((1600000000 + doc_id * 3600) * 1000000) AS created_at, md5(text) AS etag, sha256(text) AS sha256, doc_id, lang, source FROM documents)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generations: the orders of a customer are versions of one object, the greatest the current one; urgent ones are snapshots besides."""
    o = table(spark, sf_dir, "orders")
    vid = F.concat_ws("-", F.date_format("o_orderdate", "yyyyMMdd"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    own = o.select(F.lit("c").alias("container"), F.concat(F.lit("cust/"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("name"), vid.alias("v"), F.col("o_orderpriority").startswith("1").alias("snap"), (F.col("o_orderstatus") == "F").alias("gone"))
    top = own.groupBy("name").agg(F.max("v").alias("top"))
    current = F.col("v") == F.col("top")
    return own.join(top, "name").select(
        "container", "name", F.when(~current & ~F.col("snap"), F.col("v")).alias("version_id"), F.when(~current & F.col("snap"), F.col("v")).alias("snapshot"),
        F.col("v").alias("generation_id"), current.alias("is_current"), (F.col("gone") & ~current).alias("is_deleted"), F.lit(False).alias("is_directory"),
    )


VERSIONS = """own AS (SELECT 'c' AS container, 'cust/' || lpad(o_custkey::VARCHAR, 9, '0') AS name, strftime(o_orderdate, '%Y%m%d') || '-' || lpad(o_orderkey::VARCHAR, 12, '0') AS v,
  o_orderpriority LIKE '1%' AS snap, o_orderstatus = 'F' AS gone FROM orders),
versions AS (SELECT container, name, CASE WHEN v <> top AND NOT snap THEN v END AS version_id, CASE WHEN v <> top AND snap THEN v END AS snapshot, v AS generation_id,
  v = top AS is_current, gone AND v <> top AS is_deleted, false AS is_directory FROM own JOIN (SELECT name, max(v) AS top FROM own GROUP BY 1) USING (name))"""


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged blocks: an order is an object and its line numbers are blocks."""
    li = table(spark, sf_dir, "lineitem")
    own = li.groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
    return own.select(F.lit("en").alias("container"), F.concat(F.lit("src1/"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0")).alias("blob_name"), F.col("l_linenumber").cast("bigint").alias("block_id"), (F.col("q") * 512).alias("length"))


STAGED = """staged AS (SELECT 'en' AS container, 'src1/' || lpad(l_orderkey::VARCHAR, 9, '0') AS blob_name, l_linenumber::BIGINT AS block_id,
  sum(l_quantity::BIGINT)::BIGINT * 512 AS length FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ranges of one object per supplier; seq is the order key, and line 1 stands for the snapshot."""
    li = table(spark, sf_dir, "lineitem")
    start = F.lit(512) * (F.col("l_partkey") % 4096)
    return li.select(F.col("l_suppkey").alias("grp"), start.alias("start"), (start + F.lit(512) * F.col("l_quantity").cast("bigint") - 1).alias("end"), F.col("l_orderkey").alias("seq"), "l_linenumber")


RANGES = """ranges AS (SELECT l_suppkey AS grp, 512 * (l_partkey % 4096) AS start, 512 * (l_partkey % 4096) + 512 * l_quantity::BIGINT - 1 AS "end", l_orderkey AS seq, l_linenumber FROM lineitem)"""


def chunk_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter("l_quantity > 25")
    return li.select(F.col("l_orderkey").alias("blob"), F.col("l_linenumber").cast("bigint").alias("ordinal"), F.col("l_partkey").alias("chunk_id"), (F.col("l_quantity").cast("bigint") * 1024).alias("length"))


REFERENCES = "refs AS (SELECT l_orderkey AS blob, l_linenumber::BIGINT AS ordinal, l_partkey AS chunk_id, l_quantity::BIGINT * 1024 AS length FROM lineitem WHERE l_quantity > 25)"


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("chunk_id"), (F.col("p_partkey") % 64).alias("pack_id"), (F.floor(F.col("p_partkey") / 64) * 65536).alias("record_offset"), (F.col("p_size").cast("bigint") * 1000).alias("record_length"))


PACKED = "packed AS (SELECT p_partkey AS chunk_id, p_partkey % 64 AS pack_id, (p_partkey // 64) * 65536 AS record_offset, p_size::BIGINT * 1000 AS record_length FROM part)"


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed chunks, and in the same packs the former contents of large parts, which nothing refers to any more."""
    now = packed(spark, sf_dir)
    old = table(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").alias("chunk_id"))
    return now.unionByName(now.join(old, "chunk_id", "left_semi").withColumn("chunk_id", -F.col("chunk_id")))


STORED = PACKED + """, stored AS (SELECT * FROM packed UNION ALL SELECT -p_partkey, pack_id, record_offset, record_length FROM packed JOIN part ON p_partkey = chunk_id WHERE p_size > 25)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests: status by the value's range, latency is the value."""
    e = table(spark, sf_dir, "events")
    v = F.col("value")
    return e.select("event_id", F.col("ts").alias("started_at"), F.col("event_type").alias("operation"), F.when(v > 150, 503).when(v > 100, 404).otherwise(200).alias("status_code"), F.floor(v).cast("bigint").alias("e2e_ms"), F.when(F.col("user_id") % 5 == 0, "anonymous").otherwise("sas").alias("auth_type"))


LOG = """log AS (SELECT event_id, ts AS started_at, event_type AS operation, CASE WHEN value > 150 THEN 503 WHEN value > 100 THEN 404 ELSE 200 END AS status_code,
  floor(value)::BIGINT AS e2e_ms, CASE WHEN user_id % 5 = 0 THEN 'anonymous' ELSE 'sas' END AS auth_type FROM events)"""
