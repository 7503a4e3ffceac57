"""Checksums and fingerprints of stored content."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the CRC-64 polynomial, reflected.
POLYNOMIAL = 0x9A6C9329AC4BC9B5


def _table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint64)
    for _ in range(8):
        value = np.where(value & np.uint64(1), value >> np.uint64(1) ^ np.uint64(POLYNOMIAL), value >> np.uint64(1))
    return value


def crc64_of(contents: list[bytes]) -> np.ndarray:
    """CRC-64 of each content, all of them byte by byte together."""
    table, sizes = _table(), np.array([len(c) for c in contents], np.int64)
    order = np.argsort(-sizes, kind="stable")
    crc = np.full(len(contents), 0xFFFFFFFFFFFFFFFF, np.uint64)
    if not len(sizes):
        return crc
    starts, flat = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.frombuffer(b"".join(contents), np.uint8)
    live = np.searchsorted(-sizes[order], -np.arange(1, int(sizes.max()) + 1), "right")  # contents that have byte k
    for k in range(int(sizes.max())):
        rows = order[: live[k]]
        crc[rows] = crc[rows] >> np.uint64(8) ^ table[((crc[rows] ^ flat[starts[rows] + k]) & np.uint64(255)).astype(np.int64)]
    return ~crc


@F.pandas_udf(T.BinaryType())
def crc64(content: pd.Series) -> pd.Series:
    """CRC-64 of binary content as eight bytes, the lowest first."""
    known = content.notna().to_numpy()
    out = pd.Series([None] * len(content), dtype=object)
    for i, v in zip(np.flatnonzero(known), crc64_of([bytes(x) for x in content[known]]), strict=True):
        out[i] = int(v).to_bytes(8, "little")
    return out


def fingerprint(*fields: Column) -> Column:
    """SHA-256 over `length:value;` of each field, with length -1 for null; lengths in UTF-16 code units."""
    units = lambda f: (F.octet_length(F.encode(f, "UTF-16BE")) / 2).cast("int").cast("string")
    said = [F.concat(F.coalesce(units(f), F.lit("-1")), F.lit(":"), F.coalesce(f, F.lit("")), F.lit(";")) for f in fields]
    return F.sha2(F.concat(*said), 256)


def map_fields(pairs: Column, fold_case: bool = False) -> Column:
    """The fingerprint's text of a map's sorted keys and values."""
    keys = F.transform(F.map_keys(pairs), lambda k: F.upper(k) if fold_case else k)
    entries = F.array_sort(F.zip_with(keys, F.map_values(pairs), lambda k, v: F.struct(k.alias("k"), v.alias("v"))))
    units = lambda f: (F.octet_length(F.encode(f, "UTF-16BE")) / 2).cast("int").cast("string")
    piece = lambda f: F.concat(F.coalesce(units(f), F.lit("-1")), F.lit(":"), F.coalesce(f, F.lit("")), F.lit(";"))
    return F.array_join(F.transform(entries, lambda e: F.concat(piece(e["k"]), piece(e["v"]))), "")


def chain_text(x: Column, most: int = 4096) -> Column:
    """A client's text for a log: cut, control characters as spaces, HTML-encoded, quoted; empty for null and empty."""
    plain = F.regexp_replace(F.substring(x, 1, most), r"[\x00-\x1F\x7F-\x9F]", " ")
    for symbol, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        plain = F.replace(plain, F.lit(symbol), F.lit(code))
    return F.when(F.coalesce(x, F.lit("")) == "", "").otherwise(F.concat(F.lit('"'), plain, F.lit('"')))
