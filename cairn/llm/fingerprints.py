"""Operator 2: document fingerprints from closed syncmers [native].

A k-mer is K consecutive words. Of the hashes of its K - S + 1 inner S-mers the smallest decides: if it is
the first or the last, the k-mer is a closed syncmer and its hash an anchor. That depends on
the k-mer's words alone, so an edit moves no anchor but those it touches, and equal passages give equal
anchors at equal distances. The fingerprint is all anchors in order, each as eight hexadecimal digits (32 bits of its hash) and the distance
to the next one, whatever the text's length. A link is two anchors that follow each other with the distance between them, so a common
passage has common links wherever it stands; the likeness is the share of common links (of 64 bits) among all distinct ones of both,
exact, and 1 for equal lists.

With a `size`, the fingerprint is a sketch instead: the size smallest distinct anchors, and the likeness the share of common anchors among the size
smallest of both together, an estimate beyond that many anchors. The columns with `anchors` in their names are of all anchors in either case.

Defined cases: a text of fewer than K words has one anchor, the hash of all its words; a text without words
(null, empty, white space) has the empty fingerprint, like 1 to itself and 0 to others; repeated rows
each get their row; null ids come last, rows of equal ids follow each other by descending CRC-32 of the text; with one document the next one is itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

K, S = 5, 2
SKETCH = 128
#: Words are what white space separates.
SPACE = r"[ \t-\r]+"


def let(value: Column, use) -> Column:
    """use(value), where value is computed once however often it occurs."""
    return F.transform(F.array(value), use)[0]


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """The anchors of a text in order, as array<struct<place: int, hash: bigint>>."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    wide = k - s

    def of(h: Column) -> Column:
        n = F.size(h)
        inner = F.transform(F.slice(h, 1, F.greatest(n - (s - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, s)]))

        def kept(m: Column) -> Column:
            def closed(x: Column, i: Column) -> Column:
                return F.least(x, F.get(m, i + wide)) <= F.least(*[F.get(m, i + j) for j in range(1, wide)])

            places = F.transform(F.slice(m, 1, F.greatest(n - (k - 1), F.lit(0))), lambda x, i: F.when(closed(x, i), i))
            return F.transform(F.filter(places, lambda i: i.isNotNull()), lambda i: F.struct(i.alias("place"), F.xxhash64(F.slice(h, i + 1, k)).alias("hash")))

        short = F.array(F.struct(F.lit(0).alias("place"), F.xxhash64(h).alias("hash")))
        none = F.filter(short, lambda x: F.lit(False))
        return F.when(n == 0, none).when(n < k, short).otherwise(let(inner, kept))

    return let(hashes, of)


def sketch(found: Column, size: int = SKETCH) -> Column:
    """The smallest distinct ones of anchors, cut to 32 bits, in ascending order."""
    cut = F.transform(found, lambda a: a["hash"].bitwiseAND(0xFFFFFFFF))
    return F.slice(F.array_sort(F.array_distinct(cut)), 1, size)


def links(found: Column) -> Column:
    """The distinct links of anchors, in order; a lone anchor is its own link."""

    def link(a: Column, i: Column) -> Column:
        after = F.get(found, i + 1)
        return F.xxhash64(a["hash"], after["hash"], after["place"] - a["place"])

    return F.array_distinct(F.transform(F.slice(found, 1, F.greatest(F.size(found) - 1, F.least(F.size(found), F.lit(1)))), link))


def digest(found: Column) -> Column:
    """SHA-256 of all anchors in order, with their places."""
    return F.sha2(F.array_join(F.transform(found, lambda a: F.concat_ws(":", a["place"].cast("string"), a["hash"].cast("string"))), " "), 256)


def of_text(text: Column, size: int | None) -> Column:
    """struct(said, sketch, links, digest); the sketch is empty if size is None."""
    none = F.array().cast("array<bigint>")

    def of(a: Column) -> Column:
        own = none if size is None else sketch(a, size)
        return F.struct((in_order(a) if size is None else fingerprint(own)).alias("said"), own.alias("sketch"), links(a).alias("links"), digest(a).alias("digest"))

    return let(anchors(text), of)


def code(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x)), 8, "0")


def in_order(found: Column) -> Column:
    """All anchors with the distances between them as text."""
    return F.array_join(F.transform(found, lambda a, i: F.concat(code(a["hash"].bitwiseAND(0xFFFFFFFF)), F.coalesce(F.get(found, i + 1)["place"] - a["place"], F.lit(0)).cast("string"))), "")


def fingerprint(own: Column) -> Column:
    return F.array_join(F.transform(own, code), "")


def likeness(a: Column, b: Column, size: int = SKETCH) -> Column:
    both = F.slice(F.array_sort(F.array_union(a, b)), 1, size)
    return F.when(a == b, 1.0).otherwise(let(both, lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.greatest(F.size(u), F.lit(1))))


def positional_likeness(a: Column, b: Column) -> Column:
    """The share of common links, of fingerprints as of_text() gives them."""
    common = F.size(F.array_intersect(a["links"], b["links"]))
    both = lambda n: F.size(a["links"]) + F.size(b["links"]) - n
    return F.when(a["digest"] == b["digest"], 1.0).otherwise(let(common, lambda n: n / F.greatest(both(n), F.lit(1))))


def _buckets(rows: DataFrame, n: int) -> Column:
    """The number of the range of (doc_id, _tie) that a row is in, for about n ranges of equal counts, null ids first.

    An id with several ranges' rows has several, by the tie, which is spread evenly; so have the null ids.
    """
    found = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n).alias("at"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    nulls = -(-n * found["nulls"] // max(1, found["n"]))
    bounds = [(x, (j + 1) * (1 << 32) // times) for x, times in sorted(Counter(found["at"] or []).items()) for j in range(times)]
    of_null = F.floor(F.col("_tie") * nulls / (1 << 32))
    if not bounds:
        return of_null
    ids, ties = (F.array(*[F.lit(b[k]).cast("long") for b in bounds]) for k in (0, 1))
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]

    def below(at: Column) -> Column:
        return (F.get(ids, at) < F.col("doc_id")) | ((F.get(ids, at) == F.col("doc_id")) & (F.get(ties, at) <= F.col("_tie")))

    # A binary search: how many bounds are below the row.
    place = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(below(at + step - 1), at + step).otherwise(at))
    return F.when(F.col("doc_id").isNull(), of_null).otherwise(place + nulls)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_chars, _bucket and _last, with the text of the next document by descending id (after the last: the first) as _next.

    Rows are dealt to ranges of ids, so no task has all; the first document of the next range that has any is copied
    to the end of each range, which _ghost marks. Only the ranges' first ids, one each, go to the driver.
    """
    spark = docs.sparkSession
    rows = shared.texts(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
    n = 4 * shared.parts(spark)
    keyed = rows.withColumn("_tie", F.crc32("text"))
    keyed = keyed.withColumn("_bucket", _buckets(rows.select("doc_id"), n).cast("int"))
    first = "struct(doc_id is not null as known, doc_id as id, _tie as tie)"
    heads = keyed.groupBy("_bucket").agg(F.expr(f"max({first})").alias("head"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("_bucket")).collect()
    own = F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("ghost"))
    if heads:
        # A head goes to the range before its own as well; ranges come in descending order, and the first follows the last.
        to = spark.createDataFrame([(h["_bucket"], h["head"]["id"], h["head"]["tie"], heads[i - 1]["_bucket"]) for i, h in enumerate(heads)], "hb int, hid bigint, htie bigint, to int")
        is_head = (F.col("_bucket") == F.col("hb")) & F.col("doc_id").eqNullSafe(F.col("hid")) & (F.col("_tie") == F.col("htie"))
        keyed = keyed.join(F.broadcast(to), is_head, "left")
        also = F.struct(F.col("to").alias("b"), F.lit(1).alias("ghost"))
        copies = F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, also))
    else:
        copies = F.array(own)
    dealt = keyed.select("doc_id", "text", "_tie", F.explode(copies).alias("c")).select("doc_id", "text", "_tie", F.col("c.b").alias("_bucket"), F.col("c.ghost").alias("_ghost"))
    return dealt


def fingerprints(docs: DataFrame, size: int | None = SKETCH) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs; of all anchors, anchors_sha256, edited_anchors_sha256, anchors_near_edited, anchors_near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the next document's first as many.
    """
    rows = with_next(docs)
    w = Window.partitionBy("_bucket").orderBy("_ghost", F.desc_nulls_last("doc_id"), F.desc("_tie"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    both = (
        rows.withColumn("_next", F.lead("text").over(w))
        .withColumn("_edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), half)))
        .select("_bucket", "_ghost", "doc_id", "_tie", n.cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"), of_text(F.col("text"), size).alias("own"), of_text(F.col("_edited"), size).alias("edited"))
        .withColumn("next", F.lead("own").over(w))
        .filter("_ghost = 0")
    )
    own, edited, after = (F.col(c) for c in ("own", "edited", "next"))
    placed = {"near_edited": positional_likeness(own, edited), "near_next": positional_likeness(own, after)}
    near = placed if size is None else {"near_edited": likeness(own["sketch"], edited["sketch"], size), "near_next": likeness(own["sketch"], after["sketch"], size)}
    return both.select(
        "doc_id", "n_chars", "edited_sha256", own["said"].alias("fingerprint"), edited["said"].alias("edited_fingerprint"), *(c.alias(k) for k, c in near.items()),
        own["digest"].alias("anchors_sha256"), edited["digest"].alias("edited_anchors_sha256"), *(c.alias(f"anchors_{k}") for k, c in placed.items()),
    )
