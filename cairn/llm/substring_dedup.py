"""Operator 10: substring deduplication by relative Lempel-Ziv parsing.

The reference of a document is all text before it: documents with smaller ids, and its own earlier
words. Reference blocks are indexed in two steps. First every document gives its minimisers - of
the 15 six-word hashes in each 20-word window the smallest - of which only those of two or more
places can lie in a copied window; they go to every task as a bitmap sized by their number, or, if they are too many for one,
each document gets its own ones by a join. Then each window with such a minimiser goes to the dictionary, a table of window hash (128 bits) and first place. A document is
parsed greedily against it: a factor runs on while every next window, also across the point where
it leaves one reference place for another, starts earlier somewhere; a factor of 20 words or more is a
duplicate span.

A bit that is set by chance costs a row in the dictionary, never a result. Copies of a window meet in
a sum with one row per task and window, so neither a passage in a third of all documents nor a large
group of copies makes a large group.

Defined cases: a null or empty text has no words, and 0 are removed; a document with under `window`
words keeps all; rows with equal id and text are one document and get equal results; rows with equal
id and different text are ordered by a hash of the text; a null id is before all others; an empty
table gives no rows; other columns are kept by `without_repeats` and ignored by `repeat_spans`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Words of a minimiser.
GRAM = 6


def minimisers(h: np.ndarray, window: int) -> np.ndarray:
    """For each window of words, the smallest of its GRAM-word hashes."""
    return _sliding_min(shared.grams(h, GRAM), window - GRAM + 1)


def _sliding_min(a: np.ndarray, k: int) -> np.ndarray:
    if len(a) < k:
        return a[:0]
    size, out = 1, a
    while size * 2 <= k:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return out if size == k else np.minimum(out[: len(a) - k + 1], out[k - size :][: len(a) - k + 1])


def first_places(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The index of the first of each distinct pair (hi, lo)."""
    order = np.argsort(hi, kind="stable")
    a, b = hi[order], lo[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():  # two hashes with one half in common
        order = np.lexsort((lo, hi))
        a, b = hi[order], lo[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    return order[np.concatenate([[True], ~same])] if len(order) else order


def _anchors(window: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = batch.column("text")
            found = [shared.distinct(minimisers(shared.word_hashes(said[i].as_py()), window)) for i in range(len(said))]
            lists = shared.lists([shared.signed(x) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), lists], names=["doc_id", "key", "anchors"])

    return of


def _places(window: int, bitmap):
    """The dictionary's entries: each candidate window of a document, at its first place there."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple] = {}  # an equal text with a larger key can't be first anywhere
        for batch in batches:
            ids, keys, said, shared_ones = (batch.column(c) for c in ("doc_id", "key", "text", "shared"))
            out = []
            for i in range(len(said)):
                h = shared.word_hashes(said[i].as_py())
                if len(h) < window:
                    continue
                mine = ids[i].as_py()
                mine = (mine is not None, mine or 0, keys[i].as_py())
                digest = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
                if seen.get(digest, mine) < mine:
                    continue
                if len(seen) >= shared.WORDS_HELD:
                    seen.clear()
                seen[digest] = mine
                at = candidates(h, window, bitmap, shared_ones[i])
                hi, lo = (x[at] for x in shared.wide_grams(h, window))
                first = first_places(hi, lo)
                out.append((i, shared.signed(hi[first]), shared.signed(lo[first]), at[first]))
            rows = np.repeat([x[0] for x in out], [len(x[1]) for x in out]).astype(np.int64)
            flat = [np.concatenate([x[k] for x in out]) if out else np.empty(0, np.int64) for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[0], pa.int64()), pa.array(flat[1], pa.int64()), ids.take(pa.array(rows)), keys.take(pa.array(rows)), pa.array(flat[2], pa.int32())],
                names=["w", "v", "doc_id", "key", "start"],
            )

    return of


def candidates(h: np.ndarray, window: int, bitmap, own: pa.ListScalar) -> np.ndarray:
    """The starts of the windows whose minimiser other documents have: by the bitmap, else by the document's own list."""
    m = minimisers(h, window)
    if bitmap is not None:
        return np.flatnonzero(shared.members(bitmap.value, m))
    return np.flatnonzero(np.isin(m, own.values.to_numpy().view(np.uint64))) if own.values is not None else np.empty(0, np.int64)


def parse(h: np.ndarray, window: int, at: np.ndarray, firsts: np.ndarray) -> list[tuple[int, int]]:
    """Factors (start, end) in words. at: starts of the candidate windows; firsts: of those windows that the dictionary has at this document."""
    n = len(h)
    if n < window:
        return []
    earlier = np.zeros(n - window + 1, bool)
    earlier[at] = True
    earlier[firsts] = False
    own = np.ones(n - window + 1, bool)  # windows that an earlier place of the same document has
    own[first_places(*shared.wide_grams(h, window))] = False
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (earlier | own).astype(np.int8), [0]])))
    factors = []
    for start, last in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        end = last + window - 1
        if factors and start <= factors[-1][1]:
            factors[-1] = (factors[-1][0], end)
        else:
            factors.append((start, end))
    return factors


def _cut(window: int, bitmap, names: list[str], schema: pa.Schema):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, firsts, shared_ones = batch.column("__cairn_text"), batch.column("__cairn_firsts"), batch.column("__cairn_shared")
            counts, removed, spans, left = [], [], [], []
            for i in range(len(said)):
                raw = said[i].as_py()
                h, at = shared.word_hashes(raw), firsts[i].values
                able = candidates(h, window, bitmap, shared_ones[i]) if len(h) >= window else []
                factors = parse(h, window, able, at.to_numpy() if at is not None else np.empty(0, np.int64))
                counts.append(len(h))
                removed.append(sum(b - a for a, b in factors))
                spans.append([{"start": a, "end": b} for a, b in factors])
                words = raw.split() if factors else []
                for a, b in reversed(factors):
                    del words[a:b]
                left.append(b" ".join(words) if factors else raw)
            own = [batch.column(c) for c in names]
            more = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, schema.field("__cairn_spans").type), pa.array(left, pa.binary())]
            yield pa.RecordBatch.from_arrays([*own, *more], schema=schema)

    return cut


def single_spaced(text: Column) -> Column:
    """A text's words joined by one space."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t-\r]+", " "), "^ | $", "")


def without_repeats(docs: DataFrame, window: int = 20, most: int = shared.MEMBERS) -> DataFrame:
    """docs, with _n_words, _n_removed, _spans (of words) and _left: the text, untouched where nothing is removed, else the kept words joined by one space.

    Up to `most` shared minimisers are broadcast.
    """
    # Only where ids repeat has a document to be told from others by its text.
    repeated = not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    key = F.xxhash64(F.coalesce("text", F.lit(""))) if repeated else F.lit(0).cast("long")
    raw = F.coalesce("text", F.lit("")).cast("binary")
    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), raw.alias("text"))

    anchors = bare.mapInArrow(_anchors(window), "doc_id bigint, key bigint, anchors array<bigint>").select("doc_id", "key", F.explode("anchors").alias("hash"))
    several = shared.stored(anchors.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"), "anchors")
    bitmap = shared.bitmap(several, most)
    if bitmap is None:
        own = anchors.join(several, "hash").groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).agg(F.collect_list("hash").alias("shared"))
        bare = bare.join(own, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left").drop("_d", "_k")
        own = own.select(F.col("_d").alias("__cairn_e"), F.col("_k").alias("__cairn_l"), F.col("shared").alias("__cairn_shared"))
    else:
        bare = bare.withColumn("shared", F.lit(None).cast("array<bigint>"))

    place = "struct(doc_id, key, start)"
    firsts = (
        bare.mapInArrow(_places(window, bitmap), "w bigint, v bigint, doc_id bigint, key bigint, start int")
        .groupBy("w", "v").agg(F.expr(f"min({place})").alias("first"))
        .groupBy(F.col("first.doc_id").alias("__cairn_d"), F.col("first.key").alias("__cairn_k")).agg(F.collect_list("first.start").alias("__cairn_firsts"))
    )
    names = docs.columns
    rows = docs.withColumns({"__cairn_id": F.col("doc_id").cast("long"), "__cairn_key": key})
    rows = rows.join(firsts, F.col("__cairn_id").eqNullSafe(F.col("__cairn_d")) & (F.col("__cairn_key") == F.col("__cairn_k")), "left")
    if bitmap is None:
        rows = rows.join(own, F.col("__cairn_id").eqNullSafe(F.col("__cairn_e")) & (F.col("__cairn_key") == F.col("__cairn_l")), "left")
    else:
        rows = rows.withColumn("__cairn_shared", F.lit(None).cast("array<bigint>"))
    rows = rows.select(*names, raw.alias("__cairn_text"), "__cairn_firsts", "__cairn_shared")
    out = docs.limit(0).withColumns(
        {"__cairn_n_words": F.lit(0).cast("long"), "__cairn_n_removed": F.lit(0).cast("long"), "__cairn_spans": F.expr("array(named_struct('start', 1, 'end', 1))"), "__cairn_left": F.lit(b"")}
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(out.schema)
    return rows.mapInArrow(_cut(window, bitmap, names, schema), out.schema).withColumn("__cairn_left", F.col("__cairn_left").cast("string"))
