"""Manifests: ordered chunks of an object, block lists, and content-defined chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_offsets(df: DataFrame, group: list[str], place: str) -> DataFrame:
    """Adds offset: the sum of the lengths before."""
    w = Window.partitionBy(*group).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)))


def zero_runs(df: DataFrame, group: list[str], place: str, is_zero: Column) -> DataFrame:
    """Consecutive zero chunks as one: group, place (of the first), id, length."""
    w = Window.partitionBy(*group).orderBy(place)
    goes_on = is_zero & F.coalesce(F.lag(is_zero).over(w), F.lit(False))
    runs = df.withColumn("_new", (~goes_on).cast("int")).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy(*group, "_run").agg(F.min(place).alias(place), F.min_by("id", place).alias("id"), F.sum("length").alias("length")).drop("_run")


def sliced(df: DataFrame, low: Column, high: Column) -> DataFrame:
    """The chunks (offset, length) of [low, high), cut at its borders, with `skip`: bytes of the chunk before the part."""
    end = F.col("offset") + F.col("length")
    inside = df.filter((F.col("offset") < high) & (end > low))
    start, stop = F.greatest("offset", low), F.least(end, high)
    return inside.withColumns({"skip": start - F.col("offset"), "length": stop - start, "offset": start - low})


def replaced(df: DataFrame, patch: DataFrame, group: list[str]) -> DataFrame:
    """Chunks (group, id, offset, length, skip) with the patch's range put in the place of what was there."""
    span = patch.groupBy(*group).agg(F.min("offset").alias("_lo"), F.max(F.col("offset") + F.col("length")).alias("_hi"))
    own = df.join(span, group, "left")
    end = F.col("offset") + F.col("length")
    before = own.filter(F.col("_lo").isNull() | (F.col("offset") < F.col("_lo"))).withColumn("length", F.least(end, F.coalesce("_lo", end)) - F.col("offset"))
    after = own.filter(end > F.col("_hi"))
    cut = F.greatest(F.col("offset"), F.col("_hi"))
    after = after.withColumns({"skip": F.col("skip") + cut - F.col("offset"), "length": end - cut, "offset": cut})
    names = [*group, "id", "offset", "length", "skip"]
    return before.select(names).unionByName(after.select(names)).unionByName(patch.select(names))


def resized(df: DataFrame, group: list[str], size: Column, zero: Column) -> DataFrame:
    """Chunks (group, id, offset, length, skip) of [0, size): what is beyond is cut, and a zero chunk fills what lacks."""
    names = [*group, "id", "offset", "length", "skip"]
    kept = df.filter(F.col("offset") < size).withColumn("length", F.least("length", size - F.col("offset")))
    ends = df.groupBy(*group).agg(F.max(F.col("offset") + F.col("length")).alias("offset"))
    fill = ends.filter(F.col("offset") < size).select(*group, zero.alias("id"), "offset", (size - F.col("offset")).alias("length"), F.lit(0).cast("bigint").alias("skip"))
    return kept.select(names).unionByName(fill.select(names))


def resolved_blocks(wanted: DataFrame, staged: DataFrame, committed: DataFrame, group: list[str]) -> DataFrame:
    """The content of each wanted block (group, ordinal, block_id, source): source is Committed, Uncommitted or Latest, which takes a staged block before a committed one. Of committed blocks with one id the last counts; fault marks ids that aren't there."""
    last = committed.groupBy(*group, "block_id").agg(F.max_by("content", "ordinal").alias("_committed"))
    fresh = staged.groupBy(*group, "block_id").agg(F.max_by("content", "created_at").alias("_staged"))
    own = wanted.join(fresh, [*group, "block_id"], "left").join(last, [*group, "block_id"], "left")
    content = F.when(F.col("source") == "Committed", F.col("_committed")).when(F.col("source") == "Uncommitted", F.col("_staged")).otherwise(F.coalesce("_staged", "_committed"))
    return own.select(*group, "ordinal", "block_id", content.alias("content"), content.isNull().alias("fault"))


def block_list(committed: DataFrame, staged: DataFrame, kind: str = "all") -> DataFrame:
    """name, state, ordinal, block_id, length."""
    a = committed.select("name", F.lit("committed").alias("state"), "ordinal", "block_id", "length")
    b = staged.select("name", F.lit("uncommitted").alias("state"), F.lit(None).cast("bigint").alias("ordinal"), "block_id", "length")
    return {"committed": a, "uncommitted": b, "all": a.unionByName(b)}[kind]


WINDOW = 64
#: The steps and multipliers of the generator that fills the table of 256 byte hashes.
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _gear() -> np.ndarray:
    """A 64-bit hash of each byte value, from a counter that starts one step on."""
    x = np.uint64(STEP) * np.arange(2, 258, dtype=np.uint64)
    x = (x ^ x >> np.uint64(30)) * np.uint64(FIRST)
    x = (x ^ x >> np.uint64(27)) * np.uint64(SECOND)
    return x ^ x >> np.uint64(31)


def _turned(x: np.ndarray, k: int) -> np.ndarray:
    return x << np.uint64(k) | x >> np.uint64(64 - k)


def chunk_lengths(content: bytes, least: int, target: int, most: int) -> list[int]:
    """Lengths of content-defined chunks.

    A cut follows the byte where the low bits of the hash of the last 64 bytes are all 0, not before `least` bytes
    and at `most` at the latest. Byte hashes turn one bit a step, so 64 of them sum up by doubling, whole
    arrays at a time. A chunk starts with a window of zero bytes that were never added but leave it, which
    turns into a constant once the window is full; so `least` has to be at least the window.
    """
    if least < WINDOW:
        raise ValueError("the least length must be that of the window, 64, at least")
    gear = _gear()
    h = gear[np.frombuffer(content, np.uint8)]
    for k in (1, 2, 4, 8, 16, 32):
        h = h.copy() if k >= len(h) else np.concatenate([h[:k], h[k:] ^ _turned(h[:-k], k)])
    constant = np.uint64(0xFFFFFFFFFFFFFFFF if bin(int(gear[0])).count("1") % 2 else 0)
    bits = min(max(round(float(np.log2(target))), 10), 30)
    cuts = np.flatnonzero((h ^ constant) & np.uint64((1 << bits) - 1) == 0)
    out, start = [], 0
    while start < len(content):
        at = np.searchsorted(cuts, start + least - 1)
        end = int(cuts[at]) + 1 if at < len(cuts) else len(content) + most
        end = min(end, start + most, len(content))
        out.append(end - start)
        start = end
    return out


def chunks(df: DataFrame, key: str, content: str, least: int = 64 << 10, target: int = 256 << 10, most: int = 1 << 20) -> DataFrame:
    """key, ordinal, offset, length, sha256 of the content-defined chunks of each row's bytes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(1)[i].as_py() or b""
                lengths = chunk_lengths(raw, least, target, most)
                ends = np.cumsum([0, *lengths])
                parts = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                own = batch.column(0).take(pa.array([i] * len(lengths), pa.int64()))
                yield pa.RecordBatch.from_arrays([own, pa.array(range(len(lengths)), pa.int64()), pa.array(ends[:-1], pa.int64()), pa.array(lengths, pa.int64()), pa.array(parts, pa.string())], names=[key, "ordinal", "offset", "length", "sha256"])

    rows = df.select(key, F.col(content).cast("binary"))
    return rows.mapInArrow(of, f"{key} {df.schema[key].dataType.simpleString()}, ordinal bigint, offset bigint, length bigint, sha256 string")
