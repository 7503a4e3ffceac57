"""Comparisons that are exact for mixed numbers, numeric for numeric-looking text, and else by UTF-16 code unit."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalars import timestamp

#: Text that counts as a number in comparisons: thousands separators, a sign before or after, an exponent, white space around.
NUMBER = r"^[\t-\r ]*([+-]?)[\t-\r ]*([0-9][0-9,]*(?:\.[0-9]*)?|\.[0-9]+)((?:[eE][+-]?[0-9]+)?)[\t-\r ]*([+-]?)[\t-\r ]*$"


#: The largest number that counts as one in a text.
MOST = "79228162514264337593543950335"


def number_key(x: Column) -> Column:
    """A number (or the text of one) as a struct that sorts by value: to 9 digits after the point, then to 18 and 28 where those fit. Null if it isn't one or is beyond MOST."""
    at = lambda digits: x.try_cast(f"decimal(38,{digits})")
    return F.when(F.abs(at(9)) <= F.lit(MOST).cast("decimal(38,9)"), F.struct(at(9).alias("to_9"), at(18).alias("to_18"), at(28).alias("to_28")))


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def numeric_text(x: Column) -> Column:
    """The number a text stands for as number_key() has it, null if it isn't one or is out of range."""
    # As sign|sign|number in one match; a character that ends a line may follow what $ matches. Of the signs, one is empty at least.
    parts = F.when(x.rlike(NUMBER), F.regexp_replace(x, NUMBER + r"[\s\S]?", "$1|$4|$2$3"))
    plain = once(parts, lambda p: F.when(p.rlike(r"^(\|[+-]?|[+-]\|)\|"), F.translate(p, "|,", "")))
    return once(plain, number_key)


def order_of(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null if either is."""
    return F.when(a < b, -1).when(a == b, 0).when(a > b, 1)


def utf16(x: Column) -> Column:
    """A binary key that sorts as the text's UTF-16 code units do."""
    return F.encode(x, "UTF-16BE")


def _order_of_once(a: Column, b: Column) -> Column:
    """order_of() for operands that are dear to compute."""
    return once(F.struct(a.alias("a"), b.alias("b")), lambda p: order_of(p["a"], p["b"]))


def compare_text(a: Column, b: Column) -> Column:
    """Two texts: as numbers if both are, as instants if both are timestamps, else by code unit."""
    return F.coalesce(*[_order_of_once(key(a), key(b)) for key in (numeric_text, timestamp, utf16)])


def compare_number_text(number: Column, text: Column) -> Column:
    """A number (long or decimal) with a text; null, a conversion error of the row, if the text isn't a number."""
    return _order_of_once(number_key(number), numeric_text(text))


def compare_long_double(a: Column, b: Column) -> Column:
    """Exact, also beyond 2**53: the double's whole part decides, then its fraction. Null for a double that isn't finite."""
    edge = 9223372036854775808.0
    whole = F.when((b >= -edge) & (b < edge), b.try_cast("bigint"))
    fraction = b - whole.cast("double")
    inside = F.when(a != whole, order_of(a, whole)).when(fraction > 0, -1).when(fraction < 0, 1).otherwise(0)
    finite = b.isNotNull() & ~F.isnan(b) & (F.abs(b) != float("inf"))
    return F.when(a.isNotNull() & finite, F.when(b >= edge, -1).when(b < -edge, 1).otherwise(inside))


@F.pandas_udf(T.IntegerType())
def compare_decimal_double(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """A decimal with a double, as exact fractions (a double's expansion outgrows DECIMAL)."""
    for a, b in parts:
        out = []
        for x, y in zip(a, b, strict=True):
            if x is None or y is None or y != y or y in (float("inf"), float("-inf")):
                out.append(None)
            else:
                p, q = Fraction(Decimal(x)), Fraction(float(y))
                out.append((p > q) - (p < q))
        yield pd.Series(out, dtype="Int32")
