"""Operator 5: BPE encoding and decoding by a table of distinct words.

1. Each task splits its documents and gives its distinct words in order of their hashes, dealt to buckets.
2. Each bucket's tasks meet: every distinct word is encoded once, and each task's share of the bucket gets its ids
   back in the order it had.
3. The documents, as positions among their task's words in that order, meet that task's shares: ids follow by
   position, and pieces by the id-to-piece table, which has a row per vocabulary entry and goes to every task.

No row is a single word: a task's words of a bucket travel as one row, so what is shuffled is what
tasks have distinct, plus two or three bytes a word of text. A digest of the words goes both ways; if
a lost task's second run had other rows than its first, the job fails rather than mix the two up.

Defined cases: a null or empty text has no ids and decodes to an empty text; repeated rows each get
their row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .word_bpe import WordBpe

WORDS = "part int, bucket int, digest binary, words string"
IDS = "part int, bucket int, digest binary, ids binary, lengths binary"
CODES = "part int, doc_id bigint, digest binary, codes binary"
RESULT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class _Partition:
    """The words of a partition's documents: codes by first place until all are known, then by (bucket, hash)."""

    def __init__(self, path: str, buckets: int):
        self.bpe, self.buckets, self.first, self.docs = WordBpe(path), buckets, {}, []
        self.flat, self.sizes = [], []
        own = self

        class Tokens(dict):
            """The number of each token; its words' codes are in flat."""

            def __missing__(self, token: str) -> int:
                first = own.first
                words = own.bpe.words_of(token)
                own.flat += [first.setdefault(w, len(first)) for w in words]
                own.sizes.append(len(words))
                self[token] = out = len(self)
                return out

        self.number = Tokens().__getitem__

    def add(self, text: str, keep: bool) -> None:
        tokens = self.bpe.tokens(text)
        if keep:
            self.docs.append(np.fromiter(map(self.number, tokens), np.uint32, len(tokens)))
        else:
            for t in set(tokens):
                self.number(t)

    def done(self) -> tuple[list[str], np.ndarray, bytes]:
        """The words by (bucket, hash), each one's bucket, and a digest of all; then codes() is ready."""
        words = list(self.first)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        bucket = h % np.uint64(self.buckets)
        order = np.lexsort((h, bucket))
        self.place = np.empty(len(words), np.uint32)
        self.place[order] = np.arange(len(words), dtype=np.uint32)
        words = [words[i] for i in order.tolist()]
        self.flat, self.sizes = np.array(self.flat, np.uint32), np.array(self.sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        return words, bucket[order].astype(np.int64), hashlib.blake2b("\n".join(words).encode(), digest_size=16).digest()

    def codes(self, tokens: np.ndarray) -> np.ndarray:
        """The places of a document's words, from its tokens' numbers."""
        sizes = self.sizes[tokens]
        shift = self.starts[tokens] - (np.cumsum(sizes) - sizes)
        return self.place[self.flat[np.arange(int(sizes.sum())) + np.repeat(shift, sizes)]]


def _split_words(path: str, buckets: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = _Partition(path, buckets), None
        for batch in batches:
            said = batch.column("text")
            for i in range(len(said)):
                own.add(said[i].as_py(), keep=False)
            part = batch.column("part")[0].as_py() if len(said) else part
        words, bucket, digest = own.done()
        ends = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
        shares = [(k, "\n".join(words[a:b])) for k, (a, b) in enumerate(pairwise(ends)) if a < b]
        for at in range(0, len(shares), 64):
            some = shares[at : at + 64]
            columns = ([part] * len(some), [k for k, _ in some], [digest] * len(some), [w for _, w in some])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True)], names=["part", "bucket", "digest", "words"]
            )

    return of


def _encode_words(path: str):
    made: list[WordBpe] = []

    def of(table: pa.Table) -> pa.Table:
        if not made:
            made.append(WordBpe(path))
        known: dict[str, list[int]] = {}
        ids, lengths = [], []
        for words in table.column("words").to_pylist():
            each = []
            for w in words.split("\n"):
                got = known.get(w)
                if got is None:
                    got = known[w] = made[0].ids(w)
                each.append(got)
            lengths.append(np.array([len(x) for x in each], np.uint32).tobytes())
            ids.append(np.array([i for x in each for i in x], np.uint32).tobytes())
        return table.drop_columns(["words"]).append_column("ids", pa.array(ids, pa.binary())).append_column("lengths", pa.array(lengths, pa.binary()))

    return of


def _split_docs(path: str, buckets: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, part = _Partition(path, buckets), [], None
        for batch in batches:
            said = batch.column("text")
            for i in range(len(said)):
                own.add(said[i].as_py(), keep=True)
            ids.append(batch.column("doc_id"))
            part = batch.column("part")[0].as_py() if len(said) else part
        _, _, digest = own.done()
        ids = pa.concat_arrays(ids) if ids else pa.array([], pa.int64())
        for at in range(0, len(ids), 500):
            codes = [planes(own.codes(t)) for t in own.docs[at : at + 500]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(codes), pa.int32()), ids.slice(at, 500), pa.array([digest] * len(codes), pa.binary()), pa.array(codes, pa.binary())],
                names=["part", "doc_id", "digest", "codes"],
            )

    return of


def planes(codes: np.ndarray) -> bytes:
    """Four-byte codes as four planes of bytes, of which the upper ones compress well; the last is left out where it is 0."""
    b = np.ascontiguousarray(codes, "<u4").view(np.uint8).reshape(-1, 4)
    wide = bool(b[:, 3].any())
    return bytes([4 if wide else 3]) + b[:, : 4 if wide else 3].T.tobytes()


def unplaned(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    return sum(b[k].astype(np.uint32) << np.uint32(8 * k) for k in range(raw[0]))


def _assemble(path: str):
    pieces: list[str] = []

    def of(docs: pa.Table, shares: pa.Table) -> pa.Table:
        if not pieces:
            pieces.extend(WordBpe(path).pieces())
        if len({*docs.column("digest").to_pylist(), *shares.column("digest").to_pylist()}) > 1:
            raise RuntimeError("a partition's rows differ between two readings; write the input to a table first")
        shares = shares.sort_by("bucket")
        said, decoded, counts = [], [], []
        for ids, lengths in zip(shares.column("ids").to_pylist(), shares.column("lengths").to_pylist(), strict=True):
            flat, sizes = np.frombuffer(ids, np.uint32).tolist(), np.frombuffer(lengths, np.uint32).tolist()
            at = 0
            for k in sizes:
                own = flat[at : at + k]
                at += k
                said.append(" ".join(map(str, own)))
                decoded.append(" ".join([pieces[i] for i in own]))
            counts += sizes
        counts = np.array(counts, np.int64)
        rows: list[list] = [[], [], []]
        for raw in docs.column("codes").to_pylist():
            codes = unplaned(raw)
            rows[0].append(int(counts[codes].sum()) if len(codes) else 0)
            codes = codes.tolist()
            for row, of_code in zip(rows[1:], (said, decoded), strict=True):
                row.append(hashlib.sha256(" ".join([of_code[c] for c in codes]).encode()).hexdigest())
        return pa.table([docs.column("doc_id"), pa.array(rows[0], pa.int64()), pa.array(rows[1]), pa.array(rows[2])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return of


def word_ids(docs: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """The table of distinct words by partition and bucket, with each word's ids."""
    rows = shared.texts(docs).withColumn("part", F.spark_partition_id())
    buckets = buckets or 2 * shared.parts(docs.sparkSession)
    return rows.select("part", "text").mapInArrow(_split_words(path, buckets), WORDS).groupBy("bucket").applyInArrow(_encode_words(path), IDS)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text, for each row of docs."""
    buckets = 2 * shared.parts(docs.sparkSession)
    rows = shared.texts(docs.withColumn("doc_id", F.col("doc_id").cast("long"))).withColumn("part", F.spark_partition_id())
    codes = rows.mapInArrow(_split_docs(path, buckets), CODES)
    return codes.groupBy("part").cogroup(word_ids(docs, path, buckets).groupBy("part")).applyInArrow(_assemble(path), RESULT)


def decode(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids array<int>): an id-to-piece join, put together by position."""
    spark = ids.sparkSession
    pieces = spark.createDataFrame(list(enumerate(WordBpe(path).pieces())), "id int, piece string")
    by_place = ids.withColumn("_row", F.monotonically_increasing_id()).select("_row", "doc_id", F.posexplode_outer("ids").alias("place", "id"))
    rows = by_place.join(F.broadcast(pieces), "id", "left").groupBy("_row", "doc_id")
    placed = rows.agg(F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("place", "piece")))).alias("all"))
    return placed.select("doc_id", F.array_join(F.col("all.piece"), " ").alias("text"))
