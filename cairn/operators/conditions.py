"""Conditional requests: entity tags, modification times, sequence numbers, content ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _matches(etag: Column, candidates: list[str]) -> Column:
    bare = F.regexp_replace(etag, '^"|"$', "")
    return reduce(lambda a, b: a | b, [F.lit(True) if c == "*" else bare == c.strip('"') for c in candidates])


def read_outcome(etag: Column, modified: Column, if_match: list[str] = (), if_none_match: list[str] = (), modified_since: Column | None = None, unmodified_since: Column | None = None) -> Column:
    """precondition_failed, not_modified or ok; times count in whole seconds. Matches and unmodified-since must both hold; none-match or modified-since is enough."""
    second = lambda t: F.date_trunc("second", t)
    failed, checks = F.lit(False), []
    if if_match:
        failed = failed | ~_matches(etag, list(if_match))
    if unmodified_since is not None:
        failed = failed | (second(modified) > second(unmodified_since))
    if if_none_match:
        checks.append(~_matches(etag, list(if_none_match)))
    if modified_since is not None:
        checks.append(second(modified) > second(modified_since))
    stale = ~reduce(lambda a, b: a | b, checks) if checks else F.lit(False)
    return F.when(failed, "precondition_failed").when(stale, "not_modified").otherwise("ok")


def legacy_outcome(etag: Column, modified: Column, exists: Column, if_match: list[str] = (), if_none_match: list[str] = (), modified_since: Column | None = None, unmodified_since: Column | None = None, write: bool = False) -> Column:
    """The first condition present decides: none-match, match, modified-since, unmodified-since."""
    second = lambda t: F.date_trunc("second", t)
    unchanged = F.lit("precondition_failed" if write else "not_modified")
    if if_none_match:
        return F.when(exists & _matches(etag, list(if_none_match)), unchanged).otherwise("ok")
    if if_match:
        return F.when(~exists | ~F.coalesce(_matches(etag, list(if_match)), F.lit(False)), "precondition_failed").otherwise("ok")
    if modified_since is not None:
        return F.when(exists & (second(modified) <= second(modified_since)), unchanged).otherwise("ok")
    if unmodified_since is not None:
        return F.when(exists & (second(modified) > second(unmodified_since)), "precondition_failed").otherwise("ok")
    return F.lit("ok")


def sequence_holds(number: Column, at_most: Column | None = None, below: Column | None = None, equal: Column | None = None) -> Column:
    tests = [t for t in (at_most is not None and number <= at_most, below is not None and number < below, equal is not None and number == equal) if t is not False]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def byte_range(said: Column, length: Column) -> Column:
    """struct(start, end) of `bytes=a-b`, `bytes=a-` or `bytes=-n`, clamped to the length; null if it is none or starts beyond it."""
    a, b = (F.regexp_extract(said, r"^bytes=([0-9]*)-([0-9]*)$", k).try_cast("bigint") for k in (1, 2))
    start = F.when(a.isNull(), F.greatest(length - b, F.lit(0))).otherwise(a)
    end = F.when(a.isNull() | b.isNull(), length - 1).otherwise(F.least(b, length - 1))
    good = said.rlike(r"^bytes=([0-9]+-[0-9]*|-[0-9]+)$") & (start < length) & (start <= end)
    return F.when(good, F.struct(start.alias("start"), end.alias("end")))
