"""Scalar functions. A null (or missing) first argument gives null, but for coalesce."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The accepted forms: year; year-month; date; each date with a T alone, hours, minutes, seconds, fractions; an offset where there is a time.
TIMESTAMP = (
    r"^([0-9]{4})(?:T|-([0-9]{2})(?:T|-([0-9]{2})(?:T(?:([0-9]{2})(?::([0-9]{2})(?::([0-9]{2})(\.[0-9]{1,7})?)?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?)?)?)?$"
)


def timestamp(x: Column) -> Column:
    """Text to TIMESTAMP: missing parts are 01 or 00, no offset is UTC; null if it isn't one of the forms or not a date."""
    part = lambda k, default: F.when(F.regexp_extract(x, TIMESTAMP, k) == "", default).otherwise(F.regexp_extract(x, TIMESTAMP, k))
    offset = F.when(F.regexp_extract(x, TIMESTAMP, 8).isin("", "Z"), "+00:00").otherwise(F.regexp_extract(x, TIMESTAMP, 8))
    said = F.concat(
        part(1, ""), F.lit("-"), part(2, "01"), F.lit("-"), part(3, "01"), F.lit(" "), part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"),
        F.substring(F.regexp_extract(x, TIMESTAMP, 7), 1, 7), offset,
    )
    return F.when(x.rlike(TIMESTAMP), said.try_cast("timestamp"))


def offset_minutes(x: Column) -> Column:
    """The offset of a timestamp's text in minutes."""
    sign = F.when(F.regexp_extract(x, TIMESTAMP, 8).startswith("-"), -1).otherwise(1)
    own = F.regexp_extract(x, TIMESTAMP, 8)
    return F.when(own.isin("", "Z"), 0).otherwise(sign * (F.substring(own, 2, 2).try_cast("int") * 60 + F.substring(own, 5, 2).try_cast("int")))


def to_int(x: Column, kind: str = "text") -> Column:
    """CAST AS INT: whole text exactly, other numbers cut towards zero; null where the cast is an error."""
    if kind == "boolean":
        return x.cast("bigint")
    if kind == "number":
        return x.try_cast("bigint")
    return F.coalesce(F.when(x.rlike(r"^\s*[+-]?[0-9]+\s*$"), x.try_cast("bigint")), F.when(~x.rlike(r"^\s*[+-]?[0-9]+\s*$"), x.try_cast("decimal(38,10)").try_cast("bigint")))


def to_float(x: Column) -> Column:
    """CAST AS FLOAT; null for what isn't a finite number."""
    d = F.when(F.rtrim(F.ltrim(x.cast("string"))).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), x.try_cast("double"))
    return F.when(F.abs(d) < float("inf"), d)


def to_bool(x: Column) -> Column:
    """CAST AS BOOLEAN of text: true or false in any case, else a number that isn't 0."""
    low = F.lower(F.trim(x))
    return F.when(low == "true", True).when(low == "false", False).otherwise(to_float(x) != 0)


def number_text(x: Column) -> Column:
    """A double as its shortest text: plain between 1e-5 and 1e15, else with an exponent of a sign and two digits at least; no trailing zeros."""
    said = x.cast("string")
    plain = F.regexp_replace(said.try_cast("decimal(38,22)").cast("string"), r"\.?0+$", "")
    power = F.substring_index(said, "E", -1).try_cast("int")
    mantissa = F.regexp_replace(F.substring_index(said, "E", 1), r"\.0$", "")
    far = F.concat(mantissa, F.when(power < 0, "E-").otherwise("E+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), F.lit("0")))
    size = F.abs(x)
    return F.when(x == 0, F.when(said.startswith("-"), "-0").otherwise("0")).when((size > 1e-5) & (size < 1e15), plain).when(power.isNotNull(), far).otherwise(said)


def substring0(x: Column, start: int, length: int | None = None) -> Column:
    """From 0, in code points, clamped to the text."""
    if start < 0 or (length or 0) < 0:
        raise ValueError("a negative start or length")
    return F.substring(x, start + 1, 2**31 - 1 - start if length is None else length)


def trim_space(x: Column) -> Column:
    return F.regexp_replace(x, r"^[\s\p{Z}\x85]+|[\s\p{Z}\x85]+$", "")


def trim_set(x: Column, symbols: str, side: str = "BOTH") -> Column:
    """Cuts all characters of the set off the side BOTH, LEADING or TRAILING."""
    own = "[" + re.sub(r"([\[\]\\^&-])", r"\\\1", symbols) + "]+"
    pattern = {"BOTH": f"^{own}|{own}$", "LEADING": f"^{own}", "TRAILING": f"{own}$"}[side]
    return F.regexp_replace(x, pattern, "")


def null_if(a: Column, b: Column) -> Column:
    return F.when(F.coalesce(a == b, F.lit(False)), None).otherwise(a)


def finite(x: Column) -> Column:
    """Null, an error of the row, where a double is not finite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def divided(a: Column, b: Column) -> Column:
    """Every division is one of doubles."""
    return finite(F.try_divide(a.cast("double"), b.cast("double")))


def add_days(x: Column, days: Column) -> Column:
    """A timestamp and a number of days, which may have a fraction."""
    whole = F.floor(days).cast("int")
    seconds = ((days - whole) * 86400).cast("decimal(18,6)")
    return x + F.make_dt_interval(whole, F.lit(0), F.lit(0), seconds)


UNITS = {"year", "month", "day", "hour", "minute", "second"}


def _unit(part: str) -> str:
    unit = part.lower().removesuffix("s")
    if unit not in UNITS:
        raise ValueError(f"no such part: {part}")
    return unit


def date_add(part: str, n: Column, x: Column) -> Column:
    """DATE_ADD: a month's end is kept within the month."""
    unit = _unit(part)
    if unit in ("year", "month"):
        return x + F.make_ym_interval(**{unit + "s": n.cast("int")})
    seconds = {"day": 86400, "hour": 3600, "minute": 60, "second": 1}[unit]
    return F.timestamp_micros(F.unix_micros(x) + n.cast("bigint") * (seconds * 1_000_000))


def date_diff(part: str, a: Column, b: Column) -> Column:
    """DATE_DIFF: boundaries crossed from a to b in UTC, not time elapsed."""
    unit = _unit(part)
    if unit == "year":
        return (F.year(b) - F.year(a)).cast("bigint")
    if unit == "month":
        return ((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)).cast("bigint")
    seconds = {"day": 86400, "hour": 3600, "minute": 60, "second": 1}[unit]
    bound = lambda x: F.floor(F.unix_micros(x) / F.lit(seconds * 1_000_000))
    return (bound(b) - bound(a)).cast("bigint")


def extract(part: str, x: Column, offset: Column | None = None) -> Column:
    """EXTRACT, in the value's own offset (minutes) where it has one."""
    if part.lower() in ("timezone_hour", "timezone_minute"):
        own = F.lit(0) if offset is None else offset
        return F.when(x.isNotNull(), (own / 60).cast("bigint") if part.lower() == "timezone_hour" else (own % 60).cast("bigint"))
    local = x if offset is None else x + F.make_dt_interval(F.lit(0), F.lit(0), offset, F.lit(0))
    return getattr(F, _unit(part))(local).cast("bigint")


#: TO_STRING's tokens, and the pattern letters that make them.
TOKENS = {
    "y": "y", "yy": "yy", "yyyy": "yyyy", "M": "M", "MM": "MM", "MMM": "MMM", "MMMM": "MMMM", "d": "d", "dd": "dd", "a": "a", "h": "h", "hh": "hh",
    "H": "H", "HH": "HH", "m": "m", "mm": "mm", "s": "s", "ss": "ss", "S": "S", "SS": "SS", "SSS": "SSS", "X": "X", "XX": "XX", "XXX": "XXX", "XXXX": "XXXX", "XXXXX": "XXXXX",
    "x": "x", "xx": "xx", "xxx": "xxx", "xxxx": "xxxx", "xxxxx": "xxxxx",
}


def to_string(x: Column, form: str) -> Column:
    """TO_STRING: the tokens above, other characters and 'quoted text' as they stand; unknown letters are an error."""
    out, said = "", ""
    for quoted, letters, other in [*_tokens(form), ("", "", "")]:
        if letters and letters not in TOKENS:
            raise ValueError(f"no such token: {letters}")
        if (letters or not (quoted or other)) and said:
            out, said = out + "'" + said + "'", ""
        out, said = out + TOKENS.get(letters, ""), said + quoted + other
    return F.date_format(x, out)


def _tokens(form: str) -> list[tuple[str, str, str]]:
    found = [(m[1] or "", m[2] or "", m[4] or "") for m in re.finditer(r"'([^']*)'|(([A-Za-z])\3*)|([^A-Za-z']+)", form)]
    if sum(len(m[0]) for m in re.finditer(r"'[^']*'|[A-Za-z]+|[^A-Za-z']+", form)) != len(form):
        raise ValueError("an open quote")
    return found
