"""Results as delimited text, JSON lines, Arrow, and logs by the hour."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .delimited import Options

#: Rows of one Arrow batch at most.
BATCH = 1024


def delimited_line(columns: list[Column], options: Options = Options()) -> Column:
    """One record without its separator: quoted only where a separator, quote or line break needs it; quotes and escapes are escaped then."""
    marks = "|".join(map(re.escape, (options.column, options.record, options.quote, "\r", "\n")))
    q, e = options.quote, options.escape

    def field(x: Column) -> Column:
        x = F.coalesce(x.cast("string"), F.lit(""))
        escaped = F.replace(x, F.lit(e), F.lit(e + e)) if e != q else x
        escaped = F.replace(escaped, F.lit(q), F.lit(e + q))
        return F.when(x.rlike(marks), F.concat(F.lit(q), escaped, F.lit(q))).otherwise(x)

    return F.concat_ws(options.column, *map(field, columns))


def delimited_lines(df: DataFrame, options: Options = Options(), header: bool = True) -> DataFrame:
    """place and line: the records (place 1) and, if there is a row at all, the header before them (place 0)."""
    rows = df.select(F.lit(1).alias("place"), delimited_line([F.col(f"`{c}`") for c in df.columns], options).alias("line"))
    if not header:
        return rows
    return df.limit(1).select(F.lit(0).alias("place"), delimited_line([F.lit(c) for c in df.columns], options).alias("line")).unionByName(rows)


def json_line(df: DataFrame) -> Column:
    """One object per row; null and missing values are null."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})


def write_delimited(df: DataFrame, path: str, options: Options = Options()) -> None:
    df.select(delimited_line([F.col(f"`{c}`") for c in df.columns], options).alias("value")).write.option("lineSep", options.record).text(path)


def write_json(df: DataFrame, path: str, record: str = "\n") -> None:
    df.select(json_line(df).alias("value")).write.option("lineSep", record).text(path)


#: Declared Arrow result types and the casts that make them.
ARROW = {"int64": "bigint", "bool": "boolean", "timestamp[ms]": "timestamp_ntz", "string": "string", "double": "double"}


def arrow_result(df: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """df cast to the declared (name, type) fields, by position; `decimal(p,s)` is a type as well."""
    if not 1 <= len(fields) <= 256 or len(fields) != len(df.columns):
        raise ValueError("InvalidArrowSchema")
    out = []
    for c, (name, kind) in zip(df.columns, fields, strict=True):
        if kind not in ARROW and not kind.startswith("decimal("):
            raise ValueError(f"InvalidArrowType: {kind}")
        out.append(F.col(f"`{c}`").cast(ARROW.get(kind, kind)).alias(name))
    return df.select(*out)


def arrow_batches(df: DataFrame) -> Iterator[pa.RecordBatch]:
    """For results that a client takes: batches of BATCH rows at most."""
    yield from df.toArrow().to_batches(max_chunksize=BATCH)


def listing_table(df: DataFrame, marker: str = "") -> pa.Table:
    """A page of a listing in Arrow: without columns that are wholly null, but for Name and ResourceType; counts and marker as metadata."""
    table = df.toArrow()  # one page, whose size the listing bounds
    keep = [c for c in table.column_names if c in ("Name", "ResourceType") or table.column(c).null_count < table.num_rows]
    return table.select(keep).replace_schema_metadata({"NumberOfRecords": str(table.num_rows), "NextMarker": marker})


def log_path(started: Column, number: Column) -> Column:
    """$logs/blob/yyyy/MM/dd/HH00/NNNNNN.log"""
    return F.concat(F.lit("$logs/blob/"), F.date_format(started, "yyyy/MM/dd/HH'00/'"), F.lpad(number.cast("string"), 6, "0"), F.lit(".log"))


def next_number(names: DataFrame, name: str = "name") -> DataFrame:
    """hour, next: one more than the greatest number among each hour's log names."""
    hit = F.regexp_extract(name, r"^\$logs/blob/([0-9]{4}/[0-9]{2}/[0-9]{2}/[0-9]{2}00)/([0-9]{6})\.log$", 2)
    hour = F.regexp_extract(name, r"^\$logs/blob/([0-9]{4}/[0-9]{2}/[0-9]{2}/[0-9]{2}00)/[0-9]{6}\.log$", 1)
    return names.filter(hit != "").groupBy(hour.alias("hour")).agg((F.max(hit.cast("bigint")) + 1).alias("next"))


def metrics_text(df: DataFrame, name: str, value: str, labels: list[str]) -> DataFrame:
    """Lines of the Prometheus text format: name{label="value",...} number; backslashes, quotes and line breaks in values are escaped."""
    said = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"')) for c in labels])
    return df.select(F.concat(F.lit(name + "{"), said, F.lit("} "), F.col(value).cast("string")).alias("line"))
