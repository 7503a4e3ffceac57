"""Delimited text. The fast reader is Spark's own; the exact one keeps what it would lose.

Exact means: empty fields are empty texts and never null, blank lines are rows of one empty field, rows may
be ragged without a header, a quote opens at a field's start alone and text after the closing one is
appended, the escape counts inside quotes alone, and each row has the byte offset of its record.
Files are read in splits and their pieces meet by file, in order, in one task a file, as a quote's state is known from the start of the
file alone. That task goes through them as a stream and holds a batch of pieces and one record at a time. The fast reader has no such order.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, pos bigint, size bigint, fields array<string>, error string"
#: Characters of one record at most.
RECORD = 16 * 1024 * 1024
#: Bytes of the lines that go together to a file's task, and records that go together to its fold.
PIECE, RUN = 8192, 1024


@dataclass(frozen=True)
class Options:
    column: str = ","
    record: str = "\n"
    quote: str = '"'
    escape: str = "\\"
    header: bool = False

    def __post_init__(self):
        marks = (self.column, self.record, self.quote, self.escape)
        if not (1 <= len(self.column) <= 16 and 1 <= len(self.record) <= 16 and len(self.quote) == len(self.escape) == 1):
            raise ValueError("separators take 1 to 16 characters, quote and escape one")
        if self.column == self.record or self.quote in (self.column, self.record) or len(set(marks)) < 3:
            raise ValueError("separators and quote must differ")


def fast(spark: SparkSession, path: str, options: Options, schema: str | None = None) -> DataFrame:
    """Spark's CSV reader with these options; all columns are texts unless a schema is given."""
    reader = spark.read.options(sep=options.column, lineSep=options.record, quote=options.quote, escape=options.escape, header=options.header)
    return (reader.schema(schema) if schema else reader).csv(path)


def by_lines(options: Options) -> bool:
    """Whether each record separator in a text is one wherever reading starts: it shares no mark with the others and can't overlap itself.

    Three bytes are left out as well: a missing separator at a file's end would look like a byte-order mark at its start.
    """
    own = options.record
    alone = not set(own) & set(options.column + options.quote + options.escape) and not any(own.startswith(own[k:]) for k in range(1, len(own)))
    return alone and len(own.encode()) != 3


def records(pieces: Iterable[str], options: Options) -> Iterator[tuple[int, list[str] | None, str | None]]:
    """(size in bytes, fields, error) of each record of a text in pieces, which end with a record separator but for the last; an error is the last."""
    col, rec, q, e = map(re.escape, (options.column, options.record, options.quote, options.escape))
    inside = re.compile((rf"((?:[^{q}{e}]|{e}.|{q}{q})*+)({q}?)" if options.quote != options.escape else rf"((?:[^{q}]|{q}{q})*+)({q}?)"), re.S)
    plain = re.compile(rf"((?:(?!{col}|{rec}).)*+)({col}|{rec}|\Z)", re.S)
    undo = re.compile(rf"{e}(.)|{q}{q}", re.S) if options.quote != options.escape else re.compile(rf"({q}){q}", re.S)
    simple, separator = by_lines(options), len(options.record.encode())
    fields: list[str] = []
    opened: list[str] | None = None  # the parts of an open quoted field
    size = chars = 0
    for content in pieces:
        bytes_of = len if content.isascii() else lambda x: len(x.encode())
        at = start = 0
        if simple and not fields and opened is None and options.quote not in content:
            *lines, rest = content.split(options.record)
            for line, end in [(x, separator) for x in lines] + ([(rest, 0)] if rest else []):
                if len(line) + (len(options.record) if end else 0) > RECORD:
                    yield bytes_of(line) + end, None, "RecordTooLarge"
                    return
                own = line.split(options.column)
                if options.record == "\n":
                    own[-1] = own[-1].removesuffix("\r")
                yield bytes_of(line) + end, own, None
            continue
        while at < len(content):
            own = ""
            if opened is None and content.startswith(options.quote, at):
                opened, at = [], at + 1
            if opened is not None:
                m = inside.match(content, at)
                if chars + m.end() - start <= RECORD:  # beyond, the record is an error and its text isn't needed
                    opened.append(undo.sub(lambda x: x[1] if x[1] is not None else options.quote, m[1]))
                if not m[2]:
                    break
                own, opened, at = "".join(opened), None, m.end()
            m = plain.match(content, at)
            at = m.end()
            own += m[1]
            last = m[2] != options.column
            fields.append(own.removesuffix("\r") if last and options.record == "\n" else own)
            if last:
                size, chars, start = size + bytes_of(content[start:at]), chars + at - start, at
                if chars > RECORD:
                    yield size, None, "RecordTooLarge"
                    return
                yield size, fields, None
                fields, size, chars = [], 0, 0
        size, chars = size + bytes_of(content[start:]), chars + len(content) - start
        if chars > RECORD:
            fields = fields[:1]
    if opened is not None:
        yield size, None, "UnclosedQuote"
    elif fields:
        yield (size, None, "RecordTooLarge") if chars > RECORD else (size, [*fields, ""], None)


def _starts(*columns: pa.Array) -> np.ndarray:
    """The places where one of the columns differs from the row before."""
    new = [pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in columns]
    return np.flatnonzero(np.logical_or.reduce(new)) + 1


def _pieces(record: bytes):
    """Lines of one split in pieces of about PIECE bytes, numbered in the task's order, a separator after each line."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = 0
        for batch in batches:
            lines = batch.column("line")
            ends = np.cumsum(pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64) + len(record))
            cuts = np.union1d(_starts(batch.column("path"), batch.column("block")), np.flatnonzero(np.diff(ends // PIECE)) + 1).astype(np.int64)
            at = [0, *cuts.tolist()] if len(lines) else []
            raw = [record.join([*lines[a:b].to_pylist(), b""]) for a, b in zip(at, [*at[1:], len(lines)], strict=True)] if at else []
            own = batch.select(["path", "block", "length"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(range(part, part + len(at)), pa.int64()), pa.array(raw, pa.binary())], names=["path", "block", "length", "part", "raw"])
            part += len(at)

    return of


def _texts(rows: Iterable[tuple[str, int, bytes]], options: Options) -> Iterator[str]:
    """A file's pieces as texts. Lines come without the byte-order mark and all with a separator; the file's length tells whether the last one has it."""
    if not by_lines(options):
        yield from (raw.decode("utf-8-sig") for _, _, raw in rows)
        return
    held, total, length, end = b"", 0, 0, len(options.record.encode())
    for _, length, raw in rows:
        if held:
            yield held.decode()
        held, total = raw, total + len(raw)
    yield (held[:-end] if total - length in (end, end - 3) else held).decode()


def _read(options: Options):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "raw")), strict=True))
        for path, own in groupby(parts, lambda row: row[0]):
            rows: list[tuple] = []
            pos, names = 0, None
            for size, fields, error in records(_texts(own, options), options):
                if options.header and names is None and not error:
                    names = fields
                    folded = [n.casefold() for n in names]
                    if not all(names) or len(set(folded)) < len(folded):
                        rows.append((path, pos, size, None, "InvalidHeaders"))
                        break
                elif options.header and not error and len(fields) != len(names):
                    rows.append((path, pos, size, None, "ParseError"))
                    break
                else:
                    rows.append((path, pos, size, fields, error))
                pos += size
                if len(rows) >= 10_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    return of


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string())
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "pos", "size", "fields", "error"])


def exact(spark: SparkSession, path: str, options: Options = Options()) -> DataFrame:
    """path, pos and size in bytes (without a byte-order mark), fields, error: the rows up to the first fatal error, and that.

    Where a record separator can't be told without the marks before it (by_lines), a file is read whole, with 2 GB at most.
    """
    if not by_lines(options):
        return spark.read.format("binaryFile").load(path).select("path", "length", F.col("content").alias("raw")).mapInArrow(_read(options), SCHEMA)
    lines = spark.read.option("lineSep", options.record).text(path)
    said = {"path": "file_path", "block": "file_block_start", "length": "file_size"}
    lines = lines.select(*[F.col(f"_metadata.{v}").alias(k) for k, v in said.items()], F.col("value").cast("binary").alias("line"))
    pieces = lines.mapInArrow(_pieces(options.record.encode()), "path string, block bigint, length bigint, part bigint, raw binary")
    return pieces.repartition("path").sortWithinPartitions("path", "block", "part").mapInArrow(_read(options), SCHEMA)


def column(k: int):
    """The field _k, from 1; null beyond a ragged row's end."""
    return F.get("fields", F.lit(k - 1))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that follow each other, up to RUN of them, as one row: path, pos of the first, sizes."""
    for batch in batches:
        pos, size = (batch.column(c).to_numpy() for c in ("pos", "size"))
        if not len(pos):
            continue
        gaps = np.flatnonzero(pos[1:] != pos[:-1] + size[:-1]) + 1
        at = np.unique(np.concatenate([np.arange(0, len(pos), RUN), gaps, _starts(batch.column("path"))])).astype(np.int32)
        sizes = pa.ListArray.from_arrays(pa.array(np.append(at, len(pos)), pa.int32()), batch.column("size"))
        own = batch.select(["path", "pos"]).take(pa.array(at))
        yield pa.RecordBatch.from_arrays([*own.columns, sizes], names=["path", "pos", "sizes"])


def split_sizes(rows: DataFrame, least: int) -> DataFrame:
    """path, part, size: the byte lengths of consecutive batches of whole records, each the first of `least` bytes or more; the tail last.

    Each batch starts where the last one ended, so a file's lengths are folded in order, as a stream; files go to tasks of their own.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = (row for batch in batches for row in zip(batch.column("path").to_pylist(), batch.column("sizes"), strict=True))
        for path, own in groupby(runs, lambda row: row[0]):
            held = part = 0
            for _, sizes in own:
                ends, found, base, at = np.cumsum(sizes.values.to_numpy()) + held, [], 0, 0
                while (at := at + int(np.searchsorted(ends[at:], base + least))) < len(ends):
                    found.append(int(ends[at]) - base)
                    base, at = int(ends[at]), at + 1
                held = int(ends[-1]) - base
                yield _sizes(path, part, found)
                part += len(found)
            yield _sizes(path, part, [held] if held else [])

    by_file = rows.select("path", "pos", "size").mapInArrow(_runs, "path string, pos bigint, sizes array<bigint>").repartition("path").sortWithinPartitions("path", "pos")
    return by_file.mapInArrow(fold, "path string, part bigint, size bigint")


def _sizes(path: str, part: int, found: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array(range(part, part + len(found)), pa.int64()), pa.array(found, pa.int64())], names=["path", "part", "size"])
