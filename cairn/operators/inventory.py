"""What is stored, what is still reachable, and what maintenance would gain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reachable(*references: DataFrame) -> DataFrame:
    """The distinct chunk ids of all reference tables, without the chunks that stand for zeros."""
    out = references[0].select("chunk_id")
    for r in references[1:]:
        out = out.unionByName(r.select("chunk_id"))
    return out.filter(~F.col("chunk_id").cast("string").endswith("/$zero")).distinct()


def garbage(physical: DataFrame, *references: DataFrame) -> DataFrame:
    """Stored chunks that no table refers to."""
    return physical.join(reachable(*references), "chunk_id", "left_anti")


def still_referenced(candidates: DataFrame, *references: DataFrame) -> DataFrame:
    return candidates.join(reachable(*references), "chunk_id", "left_semi")


def summary(blobs: DataFrame, staged: DataFrame, *references: DataFrame) -> DataFrame:
    """One row: objects, bytes, staged blocks, staged bytes, reachable chunks."""
    a = blobs.agg(F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    b = staged.agg(F.count(F.lit(1)).alias("staged_blocks"), F.coalesce(F.sum("length"), F.lit(0)).alias("staged_bytes"))
    c = reachable(*references).agg(F.count(F.lit(1)).alias("reachable_chunks"))
    rows = a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)  # one row each
    return rows.agg(*[F.max(n).alias(n) for n in rows.columns])


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same rows, as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def packs(packed: DataFrame) -> DataFrame:
    """pack_id, chunks, bytes: the size is where the last record ends."""
    return packed.groupBy("pack_id").agg(F.count(F.lit(1)).alias("chunks"), F.max(F.col("record_offset") + F.col("record_length")).alias("bytes"))


def compactable(packed: DataFrame, live: DataFrame, least: float = 0.5) -> DataFrame:
    """Packs whose dead bytes are at least this share: pack_id, bytes, dead_bytes, dead_ratio."""
    known = packed.join(live.select("chunk_id").distinct().withColumn("_live", F.lit(True)), "chunk_id", "left")
    dead = F.sum(F.when(F.col("_live").isNull(), F.col("record_length")).otherwise(0))
    own = known.groupBy("pack_id").agg(F.sum("record_length").alias("bytes"), dead.alias("dead_bytes"))
    return own.withColumn("dead_ratio", F.col("dead_bytes") / F.col("bytes")).filter(F.col("dead_ratio") >= least)


def by_status(checks: DataFrame, states: tuple[str, ...] = ("Verified", "Missing", "Corrupt", "CustomerKey")) -> DataFrame:
    return checks.agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in states])


def usage(files: DataFrame, category: Column) -> DataFrame:
    """category, files, bytes of files (path, length), such as the metadata columns of the binaryFile source."""
    return files.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
