"""Interval algebra on inclusive ranges (start, end), by group.

Everything is a sort within a group or a sum; no range is compared with all others.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import chain, groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = 512
COPY = 4 * 1024 * 1024
#: Ranges of one page of a listing at most.
MOST = 10_000


def _by_group(df: DataFrame, group: list[str]) -> DataFrame:
    """Groups dealt to all shuffle partitions. Left alone, small rows that compress well are put together to tasks of 64 MB, which are many times that once they are sorted."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group) if group else df


def merged(df: DataFrame, group: list[str], adjacent: bool = True) -> DataFrame:
    """The union: overlapping ranges become one, and touching ones too if adjacent."""
    return _merged(_by_group(df.select(*group, "start", "end"), group), group, adjacent)


def _merged(df: DataFrame, group: list[str], adjacent: bool = True) -> DataFrame:
    """merged() of ranges that are already dealt by group."""
    w = Window.partitionBy(*group).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("start") > reach + (1 if adjacent else 0)
    islands = df.select(*group, "start", "end", F.coalesce(new.cast("int"), F.lit(1)).alias("_new"))
    islands = islands.withColumn("_island", F.sum("_new").over(w))
    return islands.groupBy(*group, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def _pieces(sides: dict[str, DataFrame], group: list[str]) -> DataFrame:
    """Elementary ranges between all borders, with how many ranges of each side cover them (columns named as the sides).

    Borders are summed in their sort, equal ones together, without a table of all places in memory.
    """
    steps = None
    for k, df in enumerate(sides.values(), 1):
        borders = F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(k).alias("side")), F.struct((F.col("end") + 1).alias("at"), F.lit(-k).alias("side"))))
        own = df.filter("start <= end").select(*group, borders.alias("_b")).select(*group, F.col("_b.at").alias("start"), F.col("_b.side").alias("_side"))
        steps = own if steps is None else steps.unionByName(own)
    steps, w = _by_group(steps, group), Window.partitionBy(*group).orderBy("start")
    step = lambda k: F.when(F.col("_side") == k, 1).when(F.col("_side") == -k, -1).otherwise(0)
    covers = [F.sum(step(k)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias(n) for k, n in enumerate(sides, 1)]
    return steps.select(*group, "start", (F.lead("start").over(w) - 1).alias("end"), *covers).filter("start <= end")


def subtracted(a: DataFrame, b: DataFrame, group: list[str]) -> DataFrame:
    """What a covers and b doesn't, merged."""
    rest = _pieces({"_a": a, "_b": b}, group).filter("_a > 0 and _b = 0")
    return _merged(rest.select(*group, "start", "end"), group)


def intersected(a: DataFrame, b: DataFrame, group: list[str]) -> DataFrame:
    both = _pieces({"_a": a, "_b": b}, group).filter("_a > 0 and _b > 0")
    return _merged(both.select(*group, "start", "end"), group)


def clipped(df: DataFrame, low: Column, high: Column) -> DataFrame:
    """The parts inside [low, high]."""
    inside = df.filter((F.col("end") >= low) & (F.col("start") <= high))
    return inside.withColumns({"start": F.greatest("start", low), "end": F.least("end", high)})


def diff(now: DataFrame, before: DataFrame, rewritten: DataFrame, group: list[str]) -> DataFrame:
    """start, end, kind of the changes since a snapshot: what is only now there, or is in both and was rewritten, is changed; what was only before is cleared."""
    own = _pieces({"_now": now, "_before": before, "_new": rewritten}, group)
    kind = F.when((F.col("_now") > 0) & ((F.col("_before") == 0) | (F.col("_new") > 0)), "changed").when((F.col("_now") == 0) & (F.col("_before") > 0), "cleared")
    own = own.withColumn("kind", kind).filter("kind is not null")
    return _merged(own.select(*group, "kind", "start", "end"), [*group, "kind"])


def changed_pages(now: DataFrame, before: DataFrame, group: list[str]) -> DataFrame:
    """Ranges of pages whose content differs; pages (group, page, digest) of both sides."""
    a, b = now.select(*group, "page", F.col("digest").alias("_a")), before.select(*group, "page", F.col("digest").alias("_b"))
    other = a.join(b, [*group, "page"], "full").filter(~F.col("_a").eqNullSafe(F.col("_b")))
    pages = other.select(*group, (F.col("page") * PAGE).alias("start"), (F.col("page") * PAGE + PAGE - 1).alias("end"))
    return merged(pages, group)


def _held(rows: Iterable[tuple]) -> Iterator[tuple]:
    """start, end, seq of what holds, of (start, end, seq) by start. Kept are the ranges that may still hold, a stair: the greater the seq, the sooner the end."""
    stair: list[tuple] = []
    at, own = 0, None
    for start, end, seq in chain(rows, [(float("inf"), None, None)]):
        while stair and at < start:
            (_, top), until = stair[-1]
            stop = min(until, start - 1)
            if own and own[2] == top and own[1] + 1 == at:
                own = (own[0], stop, top)
            else:
                if own:
                    yield own
                own = (at, stop, top)
            at = stop + 1
            if stop == until:
                stair.pop()
        if end is None:
            break
        at, key = start, (seq is not None, seq)
        k = bisect_left(stair, (key,))
        if k < len(stair) and stair[k][1] >= end:
            continue
        right = k + 1 if k < len(stair) and stair[k][0] == key else k
        while k and stair[k - 1][1] <= end:
            k -= 1
        stair[k:right] = [(key, end)]
    if own:
        yield own


def _last_writers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, start, end, seq) by group and start."""
    first = next(batches, None)
    if first is None:
        return
    rows = (row for batch in chain([first], batches) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    own = ((*key, *x) for key, parts in groupby(rows, lambda row: row[:-3]) for x in _held(row[-3:] for row in parts))
    while some := list(islice(own, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), first.schema, strict=True)], names=first.schema.names)


def last_writer(df: DataFrame, group: list[str]) -> DataFrame:
    """Ranges with seq: of overlapping writes the one with the greatest seq holds; equal neighbours are merged.

    A group's ranges go by once in order of start, as a stream. What is kept of them are those that reach on and that none with a greater seq outlasts.
    """
    own = df.select(*group, F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "seq").filter("start <= end")
    by_group = _by_group(own, group) if group else own.coalesce(1)
    return by_group.sortWithinPartitions(*group, "start").mapInArrow(_last_writers, own.schema)


def split(df: DataFrame, size: int = COPY) -> DataFrame:
    """Each range in parts of at most `size` bytes, cut at start + k * size."""
    starts = F.sequence(F.col("start"), F.col("end"), F.lit(size).cast("bigint"))
    return df.withColumn("_at", F.explode(starts)).withColumns({"end": F.least(F.col("_at") + size - 1, F.col("end")), "start": F.col("_at")}).drop("_at")


def listed(df: DataFrame, offset: int, size: int | None = None) -> DataFrame:
    return df.orderBy("start").offset(offset).limit(min(max(size or MOST, 1), MOST))
