"""Operator 9: quality rules on repetition, from a suffix array over words.

Each document's words are ranked by prefix doubling until all suffixes differ; one walk through the text
gives the longest common prefix of neighbouring suffixes. Every interval of the LCP array is a
repeated substring; for each position the longest one that starts there is the larger of its two
neighbouring LCP values, and the union of those spans of at least `least` words is what repeats.

A document fails when it has under 50 words, when over half its words lie in repeated 3-word windows,
when the spans cover over `covered` of its words, or when the longest one exceeds `longest` of them.

Defined cases: a null or empty text has no words and fails; repeated rows each get a row; an empty
table gives no rows; other columns are ignored. Work is n log n in a document's words (n log^2 n where long passages repeat) and
memory about 120 bytes a word, so a text of five million words takes 600 MB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

SYMBOLS = b"#*$%&|<>"
SCHEMA = """doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint,
            base_failed boolean, covered_words bigint, longest_repeat bigint, kept boolean"""


def suffix_ranks(h: np.ndarray) -> np.ndarray:
    """The place of each suffix of h in order, by prefix doubling."""
    n = len(h)
    rank, width = np.unique(h, return_inverse=True)[1].astype(np.int64), 1
    while width < n and int(rank.max()) + 1 < n:
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        width *= 2
    return rank


def longest_repeats(h: np.ndarray) -> np.ndarray:
    """For each position of h, the length of the longest substring starting there that also starts elsewhere.

    The longest common prefixes of neighbouring suffixes follow from the last ranks alone, by a walk through the text
    in which each is at least the one before less one, so memory is linear in the words.
    """
    n = len(h)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    words, rank = np.unique(h, return_inverse=True)[1].astype(np.int64), suffix_ranks(h)
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    before = np.full(n, -1, np.int64)  # the suffix before each one in order
    before[order[1:]] = order[:-1]
    w, prev, got, k = memoryview(words), memoryview(before), memoryview(out), 0
    lcp = np.zeros(n, np.int64)
    own = memoryview(lcp)
    for i in range(n):
        j = prev[i]
        if j < 0:
            k = 0
            continue
        most = n - max(i, j)
        while k < most and w[i + k] == w[j + k]:
            k += 1
        own[i] = k
        if k > got[j]:
            got[j] = k
        if k:
            k -= 1
    return np.maximum(out, lcp)


def covered(lengths: np.ndarray) -> int:
    """Words in the union of the spans [i, i + lengths[i])."""
    if not len(lengths):
        return 0
    edge = np.zeros(len(lengths) + 1, np.int64)
    starts = np.flatnonzero(lengths)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths[starts], -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def judged(raw: bytes, min_words: int, least: int, most_covered: float, most_longest: float) -> tuple:
    """The columns of SCHEMA after doc_id for a text in UTF-8."""
    h = shared.word_hashes(raw)
    n = len(h)
    b = np.frombuffer(raw, np.uint8)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    three = spans = longest = 0
    if n > 3:
        repeats = longest_repeats(h)
        three = covered(np.where(repeats >= 3, 3, 0))
        long = np.where(repeats >= least, repeats, 0)
        spans, longest = covered(long), int(long.max())
    failed = n < min_words or 100 * three > 50 * n
    symbols = sum(raw.count(SYMBOLS[j : j + 1]) for j in range(len(SYMBOLS)))
    kept = not failed and spans <= most_covered * n and longest <= most_longest * n
    return n, int((((b & 0xC0) != 0x80) & ~shared.SPACE[b]).sum()), symbols, len(lines) - len(set(lines)), three, failed, spans, longest, kept


def _judge(*limits):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.int64()] * 2 + [pa.bool_()]
        for batch in batches:
            said = batch.column("text")
            rows = [judged(said[i].as_py(), *limits) for i in range(len(said))]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=[x.split()[0] for x in SCHEMA.split(",")])

    return judge


def _pass(*limits):
    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = batch.column("text")
            yield batch.filter(pa.array([judged((said[i].as_py() or "").encode(), *limits)[-1] for i in range(len(said))], pa.bool_()))

    return only


def quality(docs: DataFrame, min_words: int = 50, least: int = 8, most_covered: float = 0.4, most_longest: float = 0.3) -> DataFrame:
    """One row per document: its counts, whether the base rules fail it, and whether it is kept."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(_judge(min_words, least, most_covered, most_longest), SCHEMA)


def passing(docs: DataFrame, min_words: int = 50, least: int = 8, most_covered: float = 0.4, most_longest: float = 0.3) -> DataFrame:
    """The rows of docs that are kept, whole."""
    return docs.mapInArrow(_pass(min_words, least, most_covered, most_longest), docs.schema)
