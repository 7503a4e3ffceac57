"""Aggregates over a whole input: always one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.compare import numeric_text


def sum_long(x: Column) -> Column:
    """Exact; BIGINT if it fits, else an error."""
    return F.sum(x.cast("decimal(38,0)")).cast("bigint")


def sum_double(x: Column) -> Column:
    return F.sum(x.cast("double"))


def avg(x: Column) -> Column:
    """Always a double."""
    return F.sum(x.cast("double")) / F.count(x)


def sum_text(x: Column) -> Column:
    """The sum of texts as numbers, exact; rows whose text isn't a number are left out, and faults() counts them."""
    return F.sum(numeric_text(x)["to_18"])


def faults(x: Column) -> Column:
    """How many texts are no numbers: the rows that sum_text() and avg_text() leave out."""
    return F.count_if(x.isNotNull() & numeric_text(x).isNull())


def avg_text(x: Column) -> Column:
    return F.avg(numeric_text(x)["to_18"].cast("double"))


def min_text(x: Column, place: Column) -> Column:
    """Numeric-looking texts by number and before others, equal ones by place in the input; the original text is returned."""
    return F.min_by(x, F.when(x.isNotNull(), F.struct(numeric_text(x).isNull(), numeric_text(x), F.encode(x, "UTF-16BE"), place)))


def max_text(x: Column, place: Column) -> Column:
    return F.max_by(x, F.when(x.isNotNull(), F.struct(numeric_text(x).isNull(), numeric_text(x), F.encode(x, "UTF-16BE"), -place)))
