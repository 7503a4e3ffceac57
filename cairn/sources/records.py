"""JSON records and Parquet as the rows that queries see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_records(spark: SparkSession, path: str, record: str = "\n") -> DataFrame:
    """v (VARIANT) and error per record; blank ones are skipped, and unreadable ones have a ParseError."""
    lines = spark.read.option("lineSep", record).text(path).filter(~F.col("value").rlike(r"^[ \t\r\n]*$"))
    v = F.try_parse_json("value")
    kept = F.schema_of_variant(v).startswith("OBJECT") | F.schema_of_variant(v).startswith("ARRAY")
    return lines.select(F.when(kept, v).alias("v"), F.when(~F.coalesce(kept, F.lit(False)), "ParseError").alias("error"))


def normalised(df: DataFrame) -> DataFrame:
    """Parquet columns as query values: whole numbers as bigint, floats as double, binary as base64 text, dates as timestamps.

    Nested columns are an error. Only casts of columns that need them, so pruning and pushdown stay.
    """
    out = []
    for f in df.schema.fields:
        kind, c = f.dataType, F.col(f"`{f.name}`")
        if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            raise ValueError(f"UnsupportedParquetType: {f.name}")
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(kind, T.FloatType):
            c = c.cast("double")
        elif isinstance(kind, T.BinaryType):
            c = F.base64(c)
        elif isinstance(kind, T.DateType):
            c = c.cast("timestamp")
        elif isinstance(kind, T.DecimalType) and kind.scale == 0 and kind.precision == 20:
            c = F.coalesce(c.try_cast("bigint").cast("decimal(20,0)"), c)  # unsigned 64-bit
        out.append(c.alias(f.name))
    return df.select(*out)


def uuid_text(x: Column) -> Column:
    """Sixteen bytes as the text of a UUID."""
    return F.regexp_replace(F.lower(F.hex(x)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return normalised(spark.read.parquet(path))


def in_order(df: DataFrame) -> DataFrame:
    """df of files with _file and _row: its place, for a limit in input order (orderBy('_file', '_row').limit(n))."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
