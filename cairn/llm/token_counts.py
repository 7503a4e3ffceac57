"""Operator 1: token counts through a digest cache.

The cache is a table (tokenizer, content, n_tokens) in Parquet, partitioned by the tokenizer's digest.
Counting takes the distinct digests of the texts, without the texts, and anti joins them with the cache. The misses' texts are then
summed to one for each digest, within tasks first, encoded once, and the counts appended and joined back. Up to FEW misses
are broadcast, so that texts that the cache has are not shuffled; beyond that the texts' sum meets the misses by digest.
A text that a third of all documents share costs one row a task and one encoding, and no large group.

Defined cases: a null text counts as empty; repeated rows each get their count; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Characters encoded at a time: bounds the memory that the library's encodings take.
AT_ONCE = 400_000
#: Digests of misses that are broadcast at most (about 20 MB).
FEW = 200_000
CACHE = "content binary, n_tokens bigint, tokenizer string"


def tokenizer_version(path: str) -> str:
    """Digest of whatever decides the counts: the tokenizer's file, the library's version, the call's options."""
    said = f"{tokenizers.__version__}|add_special_tokens=False|no truncation|no padding"
    return hashlib.sha256(Path(path).read_bytes() + said.encode()).hexdigest()


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = tokenizers.Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        for batch in batches:
            said, counts, held, size = batch.column("text"), [], [], 0
            for i in range(len(said)):
                held.append(said[i].as_py())
                size += len(held[-1])
                if size > AT_ONCE or i + 1 == len(said):
                    counts += [len(e) for e in tok.encode_batch_fast(held, add_special_tokens=False)]
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(counts, pa.int64())], names=["content", "n_tokens"])

    return encode


def cached(spark, cache: str, version: str) -> DataFrame:
    """The counts the cache has for this tokenizer, one row per content."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "content binary, n_tokens bigint")
    rows = spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == version)
    # Two runs may have appended the same content. The sum is dealt anew before a join, which can then split the other side's hot contents.
    return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens")).hint("rebalance")


def token_counts(docs: DataFrame, tokenizer_path: str, cache: str, few: int = FEW) -> DataFrame:
    """doc_id, n_bytes, n_tokens for every row of docs; the cache at the path `cache` gains what it lacked."""
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    # This tokenizer kind has no normaliser that two texts could share a result through: the content is the text.
    keyed = shared.texts(docs).withColumn("content", F.unhex(F.sha2("text", 256)))
    misses = shared.stored(keyed.select("content").distinct().join(cached(spark, cache, version), "content", "left_anti"), "misses")
    n = misses.count()
    if n:
        one = F.first("text").alias("text")
        if n <= few:
            missing = keyed.select("content", "text").join(F.broadcast(misses), "content", "left_semi").groupBy("content").agg(one)
        else:
            missing = keyed.groupBy("content").agg(one).join(misses, "content", "left_semi")
        new = missing.mapInArrow(_encoder(tokenizer_path), "content binary, n_tokens bigint")
        new.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    shared.forget(misses)
    return keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content").join(
        cached(spark, cache, version), "content"
    ).drop("content")
