"""Operator 6: similarity join on word n-grams by rare-first prefix filtering.

A document's set is its distinct n-word shingles (hashed to 64 bits). Documents with equal sets
are one node of the join. Two nodes can only have a Jaccard similarity of t or more if they share a
shingle among the first n - ceil(t n) + 1 of each, in any common order. The order is rare-first: by how many documents
have a shingle of its bucket, one of BUCKETS by hash, then by hash. Each task counts its documents' shingles by bucket, and
the tasks' counts are summed, so the order depends on the whole table and not on how its rows are dealt; a
bucket that a frequent shingle shares costs candidates, never a link.

Candidates come from the posting lists of the prefix shingles. A list of up to SHORT nodes gives all its pairs; longer ones go through rounds that lose no link between
different components. In a round each node of a list meets one head, the node to which the list's shingle comes first: the one
with the fewest rare shingles, which is the most like all others. After each round the links found are contracted to components;
lists with more than one component get another head from outside the first one's component, and go on with further heads while rounds join components
in them. At the end the pairs that are left in different components are tried, those of lists that left the rounds early as well. So a large group of near copies costs a few candidates a node instead of all its pairs. The length and positional filters
work in the join, and so does a suffix filter on signatures: parities of the counts in 512 ranges of hashes bound how much two
sets differ (of whole sets: what differs before the shared shingle counts as well, so it leaves out no less than one on suffixes alone). Each pair that is left is compared once, by counts in 16 ranges and then exactly;
a pair that was compared is not tried again.

A node is named by 63 bits of its set; a second digest of 64 bits finds different sets with one name, which get names of their own.

Defined cases: a null text, an empty one and one without words have the empty set, which links with
nothing; with fewer words than n the whole sequence is the only shingle; repeated rows share a
component; a null id is never a component's smallest id unless it has no other; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .components import components

#: Buckets of hashes by which shingles are counted; the counts are 8 MB in every task, whatever the input.
BUCKETS = 1 << 21
#: Buckets of one row of counts.
ROW = 4096
#: A task holds so many shingles, then adds them to its counts.
COUNTED = 3_000_000
RANGES = 16
#: Ranges of hashes of the signature that the suffix filter compares before sets are fetched.
SIGNATURE = 512
#: Sets of WIDE_FROM shingles or more have a second signature of WIDE ranges, for the pairs that the first one leaves.
WIDE, WIDE_FROM = 4096, 512
#: Nodes of a short posting list at most.
SHORT = 4
#: The posting list of a shingle is dealt to SALTS tasks if its bucket has more documents above what is usual than both LONG and a task's share of all postings divided by PART.
LONG, PART, SALTS = 1000, 4, 32
NAME_BITS = 63


def shingles(raw: bytes, n: int) -> np.ndarray:
    """The sorted distinct shingles of a text in UTF-8."""
    h = shared.word_hashes(raw.lower())  # of bytes: A-Z alone
    return shared.distinct(shared.grams(h, min(n, len(h)))) if len(h) else h


def parities(s: np.ndarray, ranges: int) -> np.ndarray:
    """For each of the ranges of hashes whether the set has an odd number in it, as bits of whole numbers."""
    odd = np.bincount((s >> np.uint64(64 - ranges.bit_length() + 1)).astype(np.int64), minlength=ranges) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def name_of(s: np.ndarray, bits: int = NAME_BITS) -> tuple[int, int]:
    """The name of a set (-1 for the empty one) and a second digest."""
    if not len(s):
        return -1, 0
    x = s ^ np.arange(1, len(s) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(31)
    y = x * np.uint64(0xA0761D6478BD642F)
    y ^= y >> np.uint64(29)
    name = int(x.sum(dtype=np.uint64) ^ np.uint64(len(s)))
    return name & (1 << bits) - 1, int(y.sum(dtype=np.uint64).view(np.int64))


class Namer:
    """Names sets, with the new names of those whose name another set has as well."""

    def __init__(self, bits: int, renamed: dict[tuple[int, int], int]):
        self.bits, self.renamed = bits, renamed

    def __call__(self, s: np.ndarray) -> int:
        own = name_of(s, self.bits)
        return self.renamed.get(own, own[0]) if self.renamed else own[0]


def new_name(name: int, check: int) -> int:
    return int(shared.mixed(np.array([name], np.int64).view(np.uint64), np.array([check], np.int64).view(np.uint64))[0]) & (1 << NAME_BITS) - 1


def bucket_of(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def needed(a: int, b: int, num: int, den: int) -> int:
    """The overlap that sets of a and b elements need for a similarity of num/den: den I >= num (a + b - I)."""
    return -(-num * (a + b) // (den + num))


def prefix(size: int, num: int, den: int) -> int:
    return size - -(-num * size // den) + 1


FIRST = "doc_id bigint, text_key bigint, size bigint, node bigint, check bigint, parities array<bigint>, wide array<bigint>, block int, counts binary"
COUNTS = "block int, turn int, counts binary"


def _nodes(n: int, bits: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        pending: list[np.ndarray] = []
        total = np.zeros(BUCKETS, np.uint32)
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2 + [pa.int32(), pa.binary()]
        names = [x.split()[0] for x in FIRST.split(", ")]

        def table(*columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        def count() -> None:
            if pending:
                np.add(total, np.bincount(bucket_of(np.concatenate(pending)), minlength=BUCKETS).astype(np.uint32), out=total)
                pending.clear()

        held = 0
        for batch in batches:
            ids, said = batch.column("doc_id"), batch.column("text")
            sizes, nodes, checks, signatures, wide = [], [], [], [], []
            for i in range(len(said)):
                s = shingles(said[i].as_py(), n)
                node, check = name_of(s, bits)
                sizes.append(len(s))
                nodes.append(node)
                checks.append(check)
                pending.append(s)
                held += len(s)
                first = check not in seen
                if first:
                    seen.add(check)
                signatures.append(parities(s, SIGNATURE) if first else None)
                wide.append(parities(s, WIDE) if first and len(s) >= WIDE_FROM else None)
                if held > COUNTED:
                    count()
                    held = 0
            none = [None] * len(sizes)
            yield table(ids, batch.column("text_key"), sizes, nodes, checks, signatures, wide, none, none)
        count()
        rows = [(at // ROW, planes(total[at : at + ROW])) for at in range(0, BUCKETS, ROW) if total[at : at + ROW].any()]
        if rows:
            none = [None] * len(rows)
            yield table(*[none] * 7, *zip(*rows, strict=True))

    return of


def planes(counts: np.ndarray) -> bytes:
    """The counts as four planes of bytes, of which the upper ones are mostly 0 and compress to nothing."""
    return counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4")[:, 0]


def _sum_counts(table: pa.Table) -> pa.Table:
    total = np.zeros(ROW, np.uint64)
    for counts in table.column("counts"):
        total += unplaned(counts.as_py())
    return pa.table([table.column("block")[:1], table.column("turn")[:1], pa.array([planes(np.minimum(total, 2**32 - 1))], pa.binary())], names=["block", "turn", "counts"])


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """The sums of the tasks' counts: first of up to a thousandth of the tasks, then of those sums. BUCKETS / ROW rows go to the driver."""
    rows = rows.withColumn("turn", F.pmod(F.spark_partition_id(), F.lit(1024))).select("block", "turn", "counts")
    part = rows.groupBy("block", "turn").applyInArrow(_sum_counts, COUNTS)
    out = np.zeros(BUCKETS, np.uint32)
    for r in part.groupBy("block").applyInArrow(_sum_counts, COUNTS).collect():
        out[r["block"] * ROW : (r["block"] + 1) * ROW] = unplaned(bytes(r["counts"]))
    return out


def rare_first(s: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k shingles of a set (sorted by hash) in the common order, and their buckets' counts."""
    usual = counts[bucket_of(s)]
    order = np.argsort(usual, kind="stable")[:k]
    return s[order], usual[order]


def _postings(n: int, num: int, den: int, counted, tasks: int, name: Namer):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(counted.value, np.uint32)
        total = int(counts.sum(dtype=np.int64))
        long = max(LONG, total * (den - num) // den // tasks // PART) + 2 * total // BUCKETS
        seen: set[int] = set()
        for batch in batches:
            said = batch.column("text")
            out: list[tuple[np.ndarray, np.ndarray, int, int]] = []
            for i in range(len(said)):
                s = shingles(said[i].as_py(), n)
                if not len(s) or (node := name(s)) in seen:
                    continue
                seen.add(node)
                first, usual = rare_first(s, counts, prefix(len(s), num, den))
                out.append((shared.signed(first), usual > long, node, len(s)))
            lengths = [len(x[0]) for x in out]
            join = lambda arrays, kind: np.concatenate(arrays) if out else np.empty(0, kind)
            flat, hot = join([x[0] for x in out], np.int64), join([x[1] for x in out], bool)
            packed = np.repeat([x[3] for x in out], lengths).astype(np.int64) << 32 | join([np.arange(k) for k in lengths], np.int64)
            nodes = np.repeat([x[2] for x in out], lengths).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat, pa.int64()), pa.array(nodes, pa.int64()), pa.array(packed, pa.int64()), pa.array(np.where(hot, nodes % SALTS + 1, 0), pa.int64())],
                names=["shingle", "node", "at", "salt"],
            )

    return of


def _sets(n: int, wanted, name: Namer):
    """The sets of rows (hash, text); with a bitmap, of those rows alone whose bit it has."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = batch.column("text")
            good = np.arange(len(said)) if wanted is None else np.flatnonzero(shared.members(wanted.value, batch.column("hash").to_numpy().view(np.uint64)))
            sets = [shingles(said[i].as_py(), n) for i in good.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("hash").take(pa.array(good, pa.int64())), pa.array(list(map(name, sets)), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["hash", "node", "members"]
            )

    return of


def similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    least = needed(len(x), len(y), num, den)
    if least > min(len(x), len(y)):
        return False
    cuts = np.arange(1, RANGES, dtype=np.uint64) << np.uint64(60)
    parts = [np.diff(np.concatenate([[0], np.searchsorted(s, cuts), [len(s)]])) for s in (x, y)]
    if np.minimum(*parts).sum() < least:  # the suffix filter
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) >= least


def _verify(num: int, den: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            good = [similar(np.frombuffer(x[i].as_py(), np.uint64), np.frombuffer(y[i].as_py(), np.uint64), num, den) for i in range(len(x))]
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good)), batch.column("b").filter(pa.array(good))], names=["a", "b"])

    return of


def similarity_classes(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, name_bits: int = NAME_BITS, most: int = shared.MEMBERS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), text_key and first_key for each row of docs.

    text_key is a hash of the text; first_key is that of the component's first row, the one by (doc_id, text_key). The sets to compare are
    made again where their documents are if there are `most` of them at most, else their texts are dealt to them.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("text_key"))

    first = shared.stored(bare.mapInArrow(_nodes(n, name_bits), FIRST), "nodes")
    named = first.filter("node is not null").drop("block", "counts")
    # Different sets with one name: at 10^10 sets a few, and no more rows than that go to the driver.
    clashes = named.groupBy("node").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).filter("lo <> hi").select("node")
    renamed = {(r["node"], r["check"]): new_name(r["node"], r["check"]) for r in named.join(clashes, "node", "left_semi").select("node", "check").distinct().collect()}
    if renamed:
        table = spark.createDataFrame([(*k, v) for k, v in renamed.items()], "node bigint, check bigint, new bigint")
        named = named.join(F.broadcast(table), ["node", "check"], "left").withColumn("node", F.coalesce("new", "node")).drop("new")
    name = Namer(name_bits, renamed)
    rows = named.select("doc_id", "text_key", "size", "node")
    counted = spark.sparkContext.broadcast(bucket_counts(first.filter("block is not null").select("block", "counts")).tobytes())

    postings = bare.select("text").mapInArrow(_postings(n, num, den, counted, shared.parts(spark), name), "shingle bigint, node bigint, at bigint, salt bigint")
    # Dealt once; a list is in one task, but for those of frequent shingles, which are far fewer rows and are put together by a join.
    # The task's number keeps the filters above the exchange, so that both read the same one and the postings are made once.
    dealt = postings.repartition("shingle", "salt").withColumn("task", F.spark_partition_id())
    rare, hot = dealt.filter("salt = 0 and task >= 0"), dealt.filter("salt > 0 and task >= 0").select("shingle", "node", "at")

    size, place = (lambda c: F.shiftright(c, 32)), (lambda c: F.col(c).bitwiseAND((1 << 32) - 1))

    def turn(k: int):
        """The order in which nodes become heads of a list: the first by place, of equal ones another one in each list."""
        return F.struct(place("at"), F.xxhash64("node", "shingle", F.lit(k)))

    def with_heads(df: DataFrame, keys: list[str], hint: bool) -> DataFrame:
        """The rows of lists of two nodes or more, with the list's head."""
        heads = df.groupBy(*keys).agg(F.min_by("node", turn(1)).alias("head"), F.min_by("at", turn(1)).alias("head_at"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo <> hi")
        return df.join(heads.hint("rebalance") if hint else heads, keys).select("shingle", "node", "at", "head", "head_at", "n")

    listed = shared.stored(with_heads(rare, ["shingle", "salt"], False).unionByName(with_heads(hot, ["shingle"], True)), "lists")

    signatures = shared.stored(named.filter("parities is not null").groupBy("node").agg(F.first("parities").alias("parities"), F.first("wide").alias("wide"), F.first("size").alias("size")), "signatures")
    wides = signatures.filter("wide is not null")

    def signed(df: DataFrame, node: str, as_name: str) -> DataFrame:
        """df with the node's signature."""
        return df.join(signatures.select(F.col("node").alias("_node"), F.col("parities").alias(as_name)), F.col(node) == F.col("_node")).drop("_node")

    def least(a: str, b: str):
        return F.ceil(num * (size(a) + size(b)) / (den + num))

    def possible(a: str, b: str):
        """The length and positional filters: the first shingle that a pair shares has at most so many common ones from there on (a later one's row may fail)."""
        left = F.least(size(a) - place(a), size(b) - place(b))
        return (F.least(size(a), size(b)) * den >= F.greatest(size(a), size(b)) * num) & (left >= least(a, b))

    def near(a: str, b: str):
        """The suffix filter: sets differ in at least as many shingles as ranges in which their parities differ."""
        differ = reduce(lambda x, y: x + y, [F.bit_count(F.col("x_parities")[k].bitwiseXOR(F.col("y_parities")[k])) for k in range(SIGNATURE // 64)])
        return differ <= size(a) + size(b) - 2 * least(a, b)

    key = F.struct("doc_id", "text_key")
    owners = rows.groupBy("node").agg(F.min(key).alias("first")).select("node", "first.*")
    hashed = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text_key").alias("hash")
    compared: list[DataFrame] = []  # tables of pairs
    held: list[DataFrame] = []  # tables of sets

    def all_of(tables: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, tables)

    def verified(pairs: DataFrame) -> DataFrame | None:
        """The links among pairs (a, b) that were not compared before; None if there are none. Only the sets of their nodes are made again, each from its first document."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if compared:
            pairs = pairs.join(all_of(compared), ["a", "b"], "left_anti")
        for own, other in (("a", "x"), ("b", "y")):
            side = wides.select(F.col("node").alias(own), F.col("wide").alias(f"{other}_wide"), F.col("size").alias(f"{other}_size"))
            pairs = pairs.join(side, own, "left")
        differ = F.aggregate(F.zip_with("x_wide", "y_wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        both = F.col("x_size") + F.col("y_size")
        pairs = pairs.filter(F.coalesce(differ <= both - 2 * F.ceil(num * both / (den + num)), F.lit(True)))
        pairs = shared.stored(pairs.select("a", "b"), "pairs")
        if pairs.isEmpty():
            return None
        compared.append(pairs)
        lacking = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        if held:
            lacking = lacking.join(all_of(held).select("node"), "node", "left_anti")
        lacking = shared.stored(owners.join(lacking, "node", "left_semi").select(hashed), "lacking")
        wanted = shared.bitmap(lacking, most)
        said = bare.select(hashed, "text")
        said = said if wanted else said.join(lacking, "hash", "left_semi")
        made = said.mapInArrow(_sets(n, wanted, name), "hash bigint, node bigint, members binary")
        held.append(shared.stored((made.join(lacking, "hash", "left_semi") if wanted else made).select("node", "members"), "sets"))
        sets = all_of(held)
        x = sets.select(F.col("node").alias("a"), F.col("members").alias("x"))
        y = sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
        links = shared.stored(pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(_verify(num, den), "a bigint, b bigint"), "links")
        return None if links.isEmpty() else links

    def near_pairs(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b, a_at, b_at), each once, those that pass the suffix filter."""
        once = pairs.groupBy("a", "b").agg(F.first("a_at").alias("a_at"), F.first("b_at").alias("b_at"))
        return signed(signed(once, "a", "x_parities"), "b", "y_parities").filter(near("a_at", "b_at"))

    def labelled(nodes: DataFrame, roots: DataFrame) -> DataFrame:
        return nodes.join(roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))

    def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
        """The roots once the links, which are between different components, are added."""
        ends = lambda a, b: links.join(roots.select(F.col("node").alias(a), F.col("root").alias(b)), a, "left").withColumn(b, F.coalesce(b, a)).select("a", "b", b)
        edges = ends("a", "ra").join(ends("b", "rb"), ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        over = components(edges).select(F.col("node").alias("root"), F.col("root").alias("over")).hint("rebalance")
        every = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(roots, "node", "left_anti").select("node", F.col("node").alias("root")).unionByName(roots.select("node", "root"))
        return shared.stored(every.join(over, "root", "left").select("node", F.coalesce("over", "root").alias("root")), "roots")

    def open_rows(lists: DataFrame, roots: DataFrame) -> DataFrame:
        """The rows of lists with nodes of several components: root, n (rows of the list), top (the root of its first head)."""
        placed = labelled(lists.select("shingle", "node", "at"), roots)
        several = placed.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"), F.min_by("root", turn(1)).alias("top")).filter("lo <> hi")
        return shared.stored(placed.join(several.select("shingle", "n", "top").hint("rebalance"), "shingle"), "open")

    def pairs_with_head(rows: DataFrame) -> DataFrame:
        return rows.filter("node <> head").select(F.col("head").alias("a"), F.col("head_at").alias("a_at"), F.col("node").alias("b"), F.col("at").alias("b_at")).filter(possible("a_at", "b_at"))

    # A list of two is its head's pair; a self join is for lists of three and more.
    short, long = listed.filter(F.col("n").between(3, SHORT)), listed.filter(F.col("n") > SHORT)
    u, v = (short.select("shingle", F.col("node").alias(c), F.col("at").alias(f"{c}_at")) for c in "ab")
    every = u.join(v, (u["shingle"] == v["shingle"]) & (F.col("a") < F.col("b")) & possible("a_at", "b_at")).select("a", "a_at", "b", "b_at")
    links = verified(near_pairs(pairs_with_head(listed.filter(~F.col("n").between(3, SHORT))).unionByName(every)))
    roots = components(links) if links else spark.createDataFrame([], "node bigint, root bigint")
    still, k, rest = open_rows(long, roots), 1, []
    while links and not still.isEmpty():
        k += 1
        heads = still.filter("root <> top").groupBy("shingle").agg(F.min_by("node", turn(k)).alias("head"), F.min_by("at", turn(k)).alias("head_at"), F.min_by("root", turn(k)).alias("head_root"))
        links = verified(near_pairs(pairs_with_head(still.join(heads.hint("rebalance"), "shingle").filter("root <> head_root"))))
        if links:
            before, roots = roots, merged(roots, links)
            # Only the lists in which the round has joined components go on; the others wait for the end as they are.
            moved = roots.join(before.select("node", F.col("root").alias("old")), "node", "left").filter(F.col("root") != F.coalesce("old", "node")).select("node")
            touched = shared.stored(still.join(moved, "node", "left_semi").select("shingle").distinct(), "touched")
            rest.append(shared.stored(still.join(touched, "shingle", "left_anti").select("shingle", "node", "at"), "rest"))
            now = open_rows(still.join(touched, "shingle", "left_semi"), roots)
            shared.forget(still)
            still = now

    # What is left: the pairs of a list's nodes in different components. The rows carry the signatures, so that pairs are filtered before they are made.
    left = labelled(all_of([*rest, still.select("shingle", "node", "at")]), roots)
    if not left.isEmpty():
        both = signed(left, "node", "parities").select("shingle", "node", "at", "root", "parities")
        u, v = (both.select("shingle", F.col("node").alias(c), F.col("at").alias(f"{c}_at"), F.col("root").alias(f"r{c}"), F.col("parities").alias(f"{p}_parities")) for c, p in ("ax", "by"))
        links = verified(u.join(v, (u["shingle"] == v["shingle"]) & (F.col("ra") < F.col("rb")) & possible("a_at", "b_at") & near("a_at", "b_at")).select("a", "b"))
        if links:
            roots = merged(roots, links)

    order = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    filled = rows.filter("node >= 0")
    rooted = labelled(filled.groupBy("node").agg(F.min(order).alias("first")), roots)
    smallest = rooted.groupBy(F.col("root").alias("_root")).agg(F.min("first").alias("smallest")).hint("rebalance")
    of_nodes = rooted.join(smallest, F.col("root") == F.col("_root")).select(F.col("node").alias("_node"), "smallest").hint("rebalance")
    together = filled.join(of_nodes, F.col("node") == F.col("_node")).select(
        "doc_id", F.col("size").alias("n_shingles"), F.col("smallest.id").alias("component_id"), "text_key", F.col("smallest.key").alias("first_key")
    )
    alone = rows.filter("node < 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_key", F.col("text_key").alias("first_key"))
    return together.unionByName(alone)


def representatives(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The first row of each component of docs, whole; of repeated rows one."""
    classes = similarity_classes(docs, n, num, den)
    id_key = F.xxhash64("doc_id")
    first = classes.filter(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("first_key")))
    first = first.select(id_key.alias("__cairn_a"), F.col("text_key").alias("__cairn_b")).distinct()
    rows = docs.withColumns({"__cairn_a": id_key, "__cairn_b": F.xxhash64(F.coalesce("text", F.lit("")))})
    again = F.row_number().over(Window.partitionBy("__cairn_a", "__cairn_b").orderBy("__cairn_a", "__cairn_b"))
    return rows.join(first, ["__cairn_a", "__cairn_b"], "left_semi").withColumn("__cairn_n", again).filter("__cairn_n = 1").select(docs.columns)
