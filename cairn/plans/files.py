"""Queries that write a table in a text format and read it again. Their paths are in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import json_path
from ..sources import delimited, records, writers
from .derived import table
from .registry import query


def folder(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-cairn-")
    return f"{base.rstrip('/')}/text-{uuid.uuid4().hex}"


@query("SELECT n_nationkey::BIGINT AS key, n_name AS name FROM nation")
def q_csv_roundtrip(spark, sf):
    path, options = folder(spark), delimited.Options(column=";;", record="\n")
    df = table(spark, sf, "nation")
    writers.write_delimited(df.select(F.col("n_nationkey"), "n_name", F.lit('a "quoted";; \\ text')), path, options)
    rows = delimited.exact(spark, path, options).filter("error is null")
    return rows.filter(delimited.column(3) == 'a "quoted";; \\ text').select(delimited.column(1).cast("bigint").alias("key"), delimited.column(2).alias("name"))


@query("SELECT r_regionkey::BIGINT AS key, r_name AS name FROM region")
def q_csv_fast(spark, sf):
    path = folder(spark)
    writers.write_delimited(table(spark, sf, "region"), path)
    return delimited.fast(spark, path, delimited.Options(), "key bigint, name string")


@query("SELECT n_nationkey::BIGINT AS key, n_name AS name, n_regionkey % 2 = 0 AS missing FROM nation")
def q_json_roundtrip(spark, sf):
    path = folder(spark)
    df = table(spark, sf, "nation")
    writers.write_json(df.select("n_nationkey", "n_name", F.when(F.col("n_regionkey") % 2 == 1, F.lit(1)).alias("odd")), path)
    v = F.col("v")
    rows = records.json_records(spark, path).filter("error is null")
    return rows.select(json_path.at(v, "$.n_nationkey", "bigint").alias("key"), json_path.at(v, "$.n_name", "string").alias("name"), json_path.is_json_null(v, "$.odd").alias("missing"))


@query("""SELECT o_orderkey::BIGINT AS o_orderkey, o_totalprice, o_orderstatus = 'O' AS open, o_orderdate AS at FROM orders""")
def q_arrow_result(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderstatus") == "O", "o_orderdate")
    return writers.arrow_result(o, [("o_orderkey", "int64"), ("o_totalprice", "double"), ("open", "bool"), ("at", "timestamp[ms]")])


@query()
def q_split_sizes(spark, sf):
    """Sizes of batches of whole records of a delimited file."""
    path = folder(spark)
    writers.write_delimited(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").repartition(4, "o_orderkey"), path)
    return delimited.split_sizes(delimited.exact(spark, path), 4096).select("part", "size")
