"""What several operators need: the shared folder, word hashing, ranks without a single task."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a Python worker's hash table before it starts afresh; bounds its memory.
WORDS_HELD = 400_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) and no other column, so that extra columns can't clash."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, which spark.checkpoint.dir names.

    A local session may lack the setting and gets a folder of its own; on a cluster that folder would be on one machine alone, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-cairn-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage and outlives executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing will read it again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Values that bitmap() takes at most; its bitmap has 64 MB then.
MEMBERS = 1 << 24
_BLOCK = 32768  # bits of one block of bitmap_construct_agg


def bitmap(hashes: DataFrame, most: int = MEMBERS):
    """A broadcast bitmap of the values of the column `hash`, with at least 16 bits for each; None if there are more than `most`.

    members() asks it. A value that was not there seems to be there in one case of 16 at most. A caller needs another way for None.
    """
    spark = hashes.sparkSession
    n = hashes.count()
    if n > most:
        return None
    bits = max(_BLOCK, 1 << (16 * n).bit_length())
    slot = F.col("hash").bitwiseAND(bits - 1)
    rows = hashes.groupBy(F.floor(slot / _BLOCK).alias("block")).agg(F.bitmap_construct_agg(slot % _BLOCK).alias("bits")).toPandas()
    out = np.zeros((bits // _BLOCK, _BLOCK // 8), np.uint8)
    for k, b in zip(rows["block"], rows["bits"], strict=True):
        out[int(k)] = np.frombuffer(bytes(b), np.uint8)
    return spark.sparkContext.broadcast(out.tobytes())


def members(raw: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (unsigned) have their bit in a bitmap."""
    bits = np.frombuffer(raw, np.uint8)
    slot = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, group: str, bucket, order: list, name: str) -> DataFrame:
    """Adds `name`: places from 0 without gaps in each `group`, ordered by (bucket, *order).

    A group may hold most rows: it is numbered bucket by bucket, and the buckets' sizes are summed
    in a table of one row per group and bucket.
    """
    df = df.withColumn("_bucket", bucket)
    sizes = df.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        F.col(group).alias("_group"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(group, "_bucket").orderBy(*order)
    return (
        df.withColumn("_place", F.row_number().over(inside))
        .join(sizes, F.col(group).eqNullSafe(F.col("_group")) & F.col("_bucket").eqNullSafe(F.col("_b")))
        .withColumn(name, F.col("_before") + F.col("_place") - 1)
        .drop("_bucket", "_place", "_group", "_b", "_before")
    )


#: Bytes of white space; and masks that keep the first k bytes of eight.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed by xxh3.
LONG_WORD = 64


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text in UTF-8, in order: words are what ASCII white space separates.

    A word is mixed eight bytes at a time, all words of a text together; words of equal length up to eight bytes never meet.
    """
    b = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], SPACE[b], [True]]).view(np.int8)))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    h = sizes.astype(np.uint64)
    if not len(h):
        return h
    eight = np.lib.stride_tricks.as_strided(np.frombuffer(raw + bytes(LONG_WORD), np.uint8), (len(b) + LONG_WORD - 7, 8), (1, 1))
    own = slice(None)
    for at in range(0, min(int(sizes.max()), LONG_WORD), 8):
        if at:
            own = np.flatnonzero(sizes > at)
        lane = eight[starts[own] + at].view("<u8")[:, 0] & _FIRST[np.minimum(sizes[own] - at, 8)]
        h[own] = mixed(h[own], lane)
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : starts[i] + sizes[i]])
    return h


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted and without repeats."""
    s = np.sort(a)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-dependent 64-bit mix of two arrays of hashes."""
    h = a * np.uint64(0x9E3779B97F4A7C15) + b
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k words from hashes of words, by doubling."""
    if len(h) < k:
        return h[:0]
    out, size, done, power = None, 0, h, 1
    while True:
        if k & power:
            out = done if out is None else mixed(out[: len(done) - size], done[size:])
            size += power
            if size == k:
                return out
        done = mixed(done[:-power], done[power:])
        power *= 2


def wide_grams(h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of all windows of k words, as two arrays."""
    return grams(h, k), grams(mixed(h, np.uint64(0x9E3779B97F4A7C15)), k)


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list array of numpy arrays."""
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat, kind)).cast(pa.list_(kind))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
