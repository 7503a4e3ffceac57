"""Operator 7: packing documents into sequences by linear grouping and best fit.

Token counts are whole numbers up to the capacity, so the packing is planned on the histogram of
lengths, which has at most `capacity` entries whatever the input; the pieces themselves are numbered
within their length and look their places up in the plan.

Large lengths (over capacity / large) are sorted and cut into groups of equal cardinality, each
rounded up to its longest; a plan is made for each pair of TRIES (large, groups), and the one with the fewest sequences
is taken. Configurations of the few rounded sizes are chosen by filling a sequence
as full as the sizes left allow (a knapsack over the sizes left, the largest always taken), each used as often as
its scarcest size lasts. The actual lengths then take the slots, and the small ones go, longest first, each to
the fullest sequence with room.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .word_bpe import WordBpe

TRIES = ((2, 16), (3, 32), (4, 16), (4, 1024), (8, 16), (8, 1024))
END = 1
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _pieces(path: str, capacity: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(path)

        class Ids(dict):
            """The ids of tokens or words, as bytes; make() gives those it lacks."""

            def __init__(self, make):
                super().__init__()
                self.make = make

            def __missing__(self, key: str) -> bytes:
                if len(self) >= shared.WORDS_HELD:
                    self.clear()
                self[key] = out = self.make(key)
                return out

        of_words = Ids(lambda w: np.array(bpe.ids(w), "<u4").tobytes())
        known = Ids(lambda t: b"".join([of_words[w] for w in bpe.words_of(t)]))
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            said, out, docs = batch.column("text"), ([], [], [], []), []
            for i in range(len(said)):
                raw = b"".join(map(known.__getitem__, bpe.tokens(said[i].as_py()))) + end
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    own = raw[at : at + 4 * capacity]
                    docs.append(i)
                    for column, x in zip(out, (piece, at // 4, len(own) // 4, zlib.crc32(own)), strict=True):
                        column.append(x)
            ids = batch.column("doc_id").take(pa.array(docs, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(out[0], pa.int32()), *(pa.array(x, pa.int64()) for x in out[1:])], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return of


class Plan:
    """Sequences numbered from 0; runs of sequences with equal room; and who goes where.

    A placement (length, rank, sequence, count, each, offset): the pieces of that length with ranks
    rank .. rank + count * each - 1 go to sequences sequence .. sequence + count - 1, `each` in a row from offset.
    """

    def __init__(self, histogram: dict[int, int], capacity: int, large: int, groups: int):
        self.left, self.capacity = dict(sorted(histogram.items(), reverse=True)), capacity
        self.used, self.placements, self.sequences = dict.fromkeys(self.left, 0), [], 0
        self.room: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first sequence, count)
        self.rooms: list[int] = []
        self._configure({x: c for x, c in self.left.items() if x * large > capacity}, groups)
        for length in sorted((x for x in self.left if self.left[x]), reverse=True):
            self._best_fit(length)

    def _place(self, length: int, first: int, count: int, each: int, offset: int) -> None:
        self.placements.append((length, self.used[length], first, count, each, offset))
        self.used[length] += count * each
        self.left[length] -= count * each

    def _add_room(self, room: int, first: int, count: int) -> None:
        if room > 0 and count:
            if room not in self.room:
                bisect.insort(self.rooms, room)
                self.room[room] = []
            self.room[room].append((first, count))

    def _configure(self, large: dict[int, int], most: int) -> None:
        total = sum(large.values())
        if not total:
            return
        size = -(-total // most)
        groups: list[list[list[int]]] = []  # of [length, count], longest first
        have = size
        for length, count in large.items():
            while count:
                if have == size:
                    groups.append([])
                    have = 0
                k = min(count, size - have)
                groups[-1].append([length, k])
                have, count = have + k, count - k
        sizes, counts = [g[0][0] for g in groups], [sum(c for _, c in g) for g in groups]
        while any(counts):
            config = self._fullest(sizes, counts)
            times = min(counts[g] // k for g, k in config.items())
            first = self.sequences
            self.sequences += times
            runs = [(first, times, 0)]  # (first sequence, count, used)
            for g, k in config.items():
                counts[g] -= k * times
                for _ in range(k):
                    runs = self._fill(groups[g], runs)
            for at, count, used in runs:
                self._add_room(self.capacity - used, at, count)

    def _fullest(self, sizes: list[int], counts: list[int]) -> dict[int, int]:
        """The multiset of sizes left, with the largest, that fills a sequence most: {group: how many}."""
        top = next(g for g, c in enumerate(counts) if c)
        room = self.capacity - sizes[top]
        came = np.full(room + 1, -1, np.int64)  # the group that reached each fill first
        came[0] = len(sizes)
        for g in range(top, len(sizes)):
            for _ in range(min(counts[g] - (g == top), room // sizes[g])):
                reached = np.flatnonzero(came[: room + 1 - sizes[g]] >= 0) + sizes[g] if room >= sizes[g] else np.empty(0, np.int64)
                new = reached[came[reached] < 0]
                if not len(new):
                    break
                came[new] = g
        # Groups come in order and at most min(count, fit) rounds each, so a walk back uses no group too often except by revisits, checked here.
        for fill in np.flatnonzero(came >= 0)[::-1].tolist():
            config, at = {top: 1}, fill
            while at:
                g = int(came[at])
                config[g] = config.get(g, 0) + 1
                at -= sizes[g]
            if all(k <= counts[g] for g, k in config.items()):
                return config
        return {top: 1}

    def _fill(self, group: list[list[int]], runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """One piece of the group, longest first, into each sequence of the runs."""
        out = []
        for first, count, used in runs:
            while count:
                length, n = group[0]
                k = min(n, count)
                self._place(length, first, k, 1, used)
                out.append((first, k, used + length))
                first, count = first + k, count - k
                group[0][1] -= k
                if not group[0][1]:
                    group.pop(0)
        return out

    def _best_fit(self, length: int) -> None:
        while n := self.left[length]:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = min(self.capacity // length, n)
                count = n // each
                first = self.sequences
                self.sequences += count
                self._place(length, first, count, each, 0)
                self._add_room(self.capacity - each * length, first, count)
                continue
            room = self.rooms[at]
            first, count = self.room[room].pop()
            each = min(room // length, n)
            k = min(count, n // each)
            self._place(length, first, k, each, self.capacity - room)
            if count > k:
                self.room[room].append((first + k, count - k))
            if not self.room[room]:
                del self.room[room]
                self.rooms.pop(at)
            self._add_room(room - each * length, first, k)


def best_plan(histogram: dict[int, int], capacity: int) -> Plan:
    return min((Plan(histogram, capacity, *x) for x in TRIES), key=lambda p: p.sequences)


def _look_up(placements: list[tuple[int, int, int, int, int, int]]):
    length, rank, first, count, each, offset = (np.array(x, np.int64) for x in zip(*sorted(placements), strict=True))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.searchsorted(length, np.arange(length.max() + 1), "left"), np.searchsorted(length, np.arange(length.max() + 1), "right")
        key = np.arange(len(length))
        for batch in batches:
            own, place = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.empty(len(own), np.int64)
            for x in np.unique(own).tolist():
                mine = own == x
                at[mine] = key[low[x] : high[x]][np.searchsorted(rank[low[x] : high[x]], place[mine], "right") - 1]
            inside = place - rank[at]
            columns = [pa.array(first[at] + inside // each[at], pa.int64()), pa.array(offset[at] + inside % each[at] * own, pa.int64())]
            kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *columns], names=[*kept, "sequence_id", "offset"])

    return of


def packed(docs: DataFrame, path: str, capacity: int = 4096) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = shared.texts(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
    pieces = shared.stored(rows.mapInArrow(_pieces(path, capacity), PIECES), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    if not histogram:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    plan = best_plan(histogram, capacity)
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(8 * shared.parts(docs.sparkSession)))
    ranks = shared.ranked(pieces, "length", bucket, ["doc_id", "piece", "ids_crc32"], "rank")
    return ranks.mapInArrow(_look_up(plan.placements), PIECES + ", sequence_id bigint, offset bigint")
