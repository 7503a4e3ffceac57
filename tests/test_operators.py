"""Catalog, range and manifest operators, case by case and against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cairn.functions.compare import numeric_text
from cairn.operators import aggregates, conditions, inventory, lifecycle, listing, manifests, ranges, request_logs, tags
from cairn.plans import catalog
from cairn.streaming import hourly_logs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


class Subtractive:
    """Knuth's subtractive generator with the seeding that a seeded .NET Random has, per its public documentation."""

    def __init__(self, seed):
        big, self.state = 2**31 - 1, [0] * 56
        mj = 161803398 - abs(seed)
        self.state[55], mk, at = mj, 1, 0
        for _ in range(1, 55):
            at = at + 21 - (55 if at + 21 >= 55 else 0)
            self.state[at] = mk
            mk = mj - mk
            mk += big if mk < 0 else 0
            mj = self.state[at]
        for _ in range(4):
            for k in range(1, 56):
                n = k + 30 - (55 if k + 30 >= 55 else 0)
                self.state[k] -= self.state[1 + n]
                self.state[k] += big if self.state[k] < 0 else 0
        self.a, self.b, self.big = 0, 21, big

    def bytes(self, n):
        out = bytearray()
        for _ in range(n):
            self.a, self.b = self.a % 55 + 1, self.b % 55 + 1
            x = self.state[self.a] - self.state[self.b]
            x -= 1 if x == self.big else 0
            x += self.big if x < 0 else 0
            self.state[self.a] = x
            out.append(x & 255)
        return bytes(out)


@pytest.mark.parametrize(
    ("most", "want"), [(16384, "f502cc976116211e19cc4e0f981f43d754060c79fff641d8e53d695283c237ad"), (10000, "22e80ec485884aab6caa3c2a3f486c324b94e1b49740cf3d564eb0b2f0279f92")]
)
def test_chunk_boundaries_are_the_known_ones(most, want):
    content = Subtractive(0x6C10).bytes(196625)
    lengths = manifests.chunk_lengths(content, 4096, 8192, most)
    at, said = 0, []
    for n in lengths:
        said.append(f"{n}:{hashlib.sha256(content[at : at + n]).hexdigest()}")
        at += n
    assert hashlib.sha256("\n".join(said).encode()).hexdigest() == want


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 4097, 16385, 65537])
def test_zeros_are_cut_at_the_least_length(n):
    assert manifests.chunk_lengths(bytes(n), 4096, 8192, 16384) == [4096] * (n // 4096) + ([n % 4096] if n % 4096 else [])


def test_chunks_of_rows(spark):
    raw = random.Random(1).randbytes(20_000)
    got = manifests.chunks(spark.createDataFrame([(1, raw), (2, b""), (3, None)], "id int, c binary"), "id", "c", 256, 1024, 4096).orderBy("ordinal").collect()
    assert sum(r["length"] for r in got) == 20_000 and all(r["id"] == 1 and r["sha256"] == hashlib.sha256(raw[r["offset"] : r["offset"] + r["length"]]).hexdigest() for r in got)


def cells(rows):
    return {x for a, b in rows for x in range(a, b + 1)}


def spans(xs):
    out = []
    for x in sorted(xs):
        if out and x == out[-1][1] + 1:
            out[-1][1] = x
        else:
            out.append([x, x])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("seed", range(4))
def test_range_algebra(spark, seed):
    rng = random.Random(seed)
    some = lambda: [(a, a + rng.randrange(0, 9)) for a in (rng.randrange(60) for _ in range(rng.randrange(0, 9)))]
    a, b, new = some(), some(), some()
    df = lambda rows: spark.createDataFrame([(1, *x) for x in rows], "g int, start bigint, end bigint")
    got = lambda d: sorted((r["start"], r["end"]) for r in d.collect())
    assert got(ranges.merged(df(a), ["g"])) == spans(cells(a))
    assert got(ranges.subtracted(df(a), df(b), ["g"])) == spans(cells(a) - cells(b))
    assert got(ranges.intersected(df(a), df(b), ["g"])) == spans(cells(a) & cells(b))
    now, before, fresh = cells(a), cells(b), cells(new)
    d = ranges.diff(df(a), df(b), df(new), ["g"])
    assert got(d.filter("kind = 'changed'")) == spans({x for x in now if x not in before or x in fresh})
    assert got(d.filter("kind = 'cleared'")) == spans(before - now)
    writes = [(1, *x, k) for k, x in enumerate(a)]
    last = {}
    for _, s, e, k in writes:
        for x in range(s, e + 1):
            last[x] = k
    top = ranges.last_writer(spark.createDataFrame(writes, "g int, start bigint, end bigint, seq int"), ["g"]).collect()
    assert {x: r["seq"] for r in top for x in range(r["start"], r["end"] + 1)} == last


def test_range_pieces(spark):
    """Empty ranges cover nothing, equal borders make one piece, and no table of all places is held: the sum is in the sort."""
    df = lambda rows: spark.createDataFrame([(1, *x) for x in rows], "g int, start bigint, end bigint")
    a, b = df([(0, 20), (10, 5), (0, 20), (21, 30)]), df([(4, 20), (4, 3), (21, 21)])
    got = lambda d: sorted((r["start"], r["end"]) for r in d.collect())
    assert got(ranges.intersected(a, b, ["g"])) == [(4, 21)]
    assert got(ranges.subtracted(a, b, ["g"])) == [(0, 3), (22, 30)]
    own = ranges._pieces({"x": a, "y": b}, ["g"])
    assert got(own) == [(0, 3), (4, 20), (21, 21), (22, 30)]
    assert "Aggregate" not in own._jdf.queryExecution().executedPlan().toString()
    said = ranges.diff(a, b, a, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert said.count("Exchange hashpartitioning") == said.count("REPARTITION_BY_NUM") == 1


@pytest.mark.parametrize("seed", range(3))
def test_last_writer_ties(spark, seed):
    """Equal seqs, null ones, empty ranges and null groups; a range is moved once, whatever its length."""
    rng = random.Random(seed)
    rows = [(rng.choice([1, 2, None]), a, a + rng.randrange(-1, 30), rng.choice([None, 1, 2, 3, 4])) for a in (rng.randrange(-50, 90) for _ in range(60))]
    best = {}
    for g, s, e, seq in rows:
        for x in range(s, e + 1):
            best[g, x] = max(best.get((g, x), -1), -1 if seq is None else seq)
    want = set()
    for (g, x), seq in best.items():
        if best.get((g, x - 1)) != seq:
            end = next(y for y in range(x, 999) if best.get((g, y + 1)) != seq)
            want.add((g, x, end, None if seq < 0 else seq))
    own = ranges.last_writer(spark.createDataFrame(rows, "g int, start bigint, end bigint, seq bigint"), ["g"])
    got = [(r["g"], r["start"], r["end"], r["seq"]) for r in own.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    said = own._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in said and "Generate" not in said


def test_ranges_pages(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 3, "c")], "g int, page bigint, digest string")
    old = spark.createDataFrame([(1, 0, "a"), (1, 1, "x"), (1, 2, "y")], "g int, page bigint, digest string")
    assert [(r["start"], r["end"]) for r in ranges.changed_pages(df, old, ["g"]).collect()] == [(512, 2047)]
    parts = ranges.split(spark.createDataFrame([(5, 24)], "start bigint, end bigint"), 8).orderBy("start").collect()
    assert [(r["start"], r["end"]) for r in parts] == [(5, 12), (13, 20), (21, 24)]
    assert ranges.listed(spark.createDataFrame([(5, 6), (1, 2), (3, 4)], "start bigint, end bigint"), 1, 1).first()["start"] == 3


def test_manifest_parts(spark):
    df = spark.createDataFrame([(1, 0, "a", 10), (1, 1, "z", 5), (1, 2, "z", 5), (1, 3, "b", 10)], "g int, place int, id string, length bigint")
    runs = manifests.zero_runs(df, ["g"], "place", F.col("id") == "z")
    assert [(r["id"], r["length"], r["offset"]) for r in manifests.with_offsets(runs, ["g"], "place").orderBy("place").collect()] == [("a", 10, 0), ("z", 10, 10), ("b", 10, 20)]
    own = manifests.with_offsets(df, ["g"], "place").withColumn("skip", F.lit(0).cast("bigint"))
    cut = manifests.sliced(own, F.lit(5), F.lit(17)).orderBy("place").collect()
    assert [(r["id"], r["offset"], r["length"], r["skip"]) for r in cut] == [("a", 0, 5, 5), ("z", 5, 5, 0), ("z", 10, 2, 0)]
    patch = spark.createDataFrame([(1, "p", 8, 15, 0)], "g int, id string, offset bigint, length bigint, skip bigint")
    new = manifests.replaced(own, patch, ["g"]).orderBy("offset").collect()
    assert [(r["id"], r["offset"], r["length"], r["skip"]) for r in new] == [("a", 0, 8, 0), ("p", 8, 15, 0), ("b", 23, 7, 3)]


def test_tags(spark):
    t = F.create_map(F.lit("k"), F.lit("v"))
    ask = lambda *x: one(spark, tags.condition(tags.Tag(*x), t))
    assert [ask("k", "=", "v"), ask("k", "<>", "v"), ask("k", ">=", "a"), ask("z", "<>", "v")] == [True, False, True, False]
    blobs = spark.createDataFrame([("c", "n", True, False, None, {"k": "v"})], "container string, name string, is_current boolean, is_deleted boolean, snapshot string, tags map<string,string>")
    assert tags.find(blobs, [tags.Tag("k", "=", "v")], "c").first()["tags"] == {"k": "v"}
    with pytest.raises(ValueError):
        tags.find(blobs, [tags.Tag("k", ">", "a"), tags.Tag("k", ">=", "b")])
    with pytest.raises(ValueError):
        tags.Tag("k", "like", "v")
    index = tags.index_of(blobs)
    assert tags.index_faults(blobs, index).isEmpty() and tags.index_faults(blobs, index.limit(0)).first()["fault"] == "missing"
    assert one(spark, tags.valid_component(F.lit("a b+c"), 1, 128)) and not one(spark, tags.valid_component(F.lit("a,b"), 1, 128))


def test_conditions(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    etag, modified = F.lit('"e"'), at("2024-01-01 00:00:00.7")
    ask = lambda **x: one(spark, conditions.read_outcome(etag, modified, **x))
    assert ask() == "ok" and ask(if_match=["e"]) == "ok" and ask(if_match=["x"]) == "precondition_failed"
    assert ask(unmodified_since=at("2024-01-01 00:00:00")) == "ok"
    assert ask(if_none_match=["e"]) == "not_modified" and ask(if_none_match=["e"], modified_since=at("2023-01-01")) == "ok"
    old = lambda **x: one(spark, conditions.legacy_outcome(etag, modified, F.lit(True), **x))
    assert old(if_none_match=["*"]) == "not_modified" and old(if_none_match=["*"], write=True) == "precondition_failed" and old(if_match=["x"]) == "precondition_failed"
    ranged = lambda s: one(spark, conditions.byte_range(F.lit(s), F.lit(100)))
    assert [ranged(s) and tuple(ranged(s)) for s in ("bytes=5-9", "bytes=5-", "bytes=-7", "bytes=90-200", "bytes=100-", "x")] == [(5, 9), (5, 99), (93, 99), (90, 99), None, None]
    assert one(spark, conditions.sequence_holds(F.lit(5), at_most=F.lit(5), below=F.lit(6))) and not one(spark, conditions.sequence_holds(F.lit(5), equal=F.lit(4)))


def test_markers():
    cursor, shape = {"entry_name": "é/x", "rank": 1}, {"container": "c", "prefix": ""}
    text = listing.marker(cursor, shape)
    assert listing.cursor_of(text, shape) == cursor
    with pytest.raises(ValueError):
        listing.cursor_of(text, {"container": "d"})
    assert [listing.page_size(x) for x in (None, 0, 7, 9999)] == [5000, 5000, 7, 5000]


def test_pages_join_up(spark):
    rng = random.Random(9)
    rows = []
    for name in ("a", "a/b", "a-b", "b", "é"):
        for k in range(rng.randrange(1, 5)):
            rows.append((name, f"v{k}", None, f"g{k}", k == 0, False, False))
            rows.append((name, None, f"s{k}", f"h{k}", False, False, False))
    blobs = spark.createDataFrame(rows, "name string, version_id string, snapshot string, generation_id string, is_current boolean, is_deleted boolean, is_directory boolean").withColumn("container", F.lit("c"))
    for recursive in (False, True):
        own = listing.entries(listing.eligible(blobs, "c", snapshots=True, versions=True)).cache()
        whole, cursor, got = own.orderBy(*listing.order(recursive)).collect(), None, []
        while page := listing.page(own, 4, cursor, recursive).collect():
            got += page
            cursor = page[-1].asDict()
        assert got == whole


@pytest.mark.parametrize("name", ["q_list_bounds", "q_list_delimiter", "q_list_directories"])
def test_listings_are_whole(spark, tmp_path, name):
    """More entries than a page has, in the listing's order."""
    n = 6000
    lang, source = ("de", "src1x") if name == "q_list_directories" else ("en", "src2")
    docs = spark.range(n).select((F.col("id") * 680).alias("doc_id"), F.lit("t").alias("text"), F.lit(lang).alias("lang"), F.lit(source).alias("source"), F.lit(1).cast("long").alias("n_chars"))
    if name != "q_list_bounds":  # each object in a folder of its own, so that common prefixes are many as well
        docs = docs.withColumn("source", F.concat("source", F.col("doc_id").cast("string")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = getattr(catalog, name)(spark, str(tmp_path)).collect()
    assert len(rows) == n
    key = (lambda x: x.replace("/", "\0")) if name == "q_list_directories" else (lambda x: x)
    assert [r["entry_name"] for r in rows] == sorted((r["entry_name"] for r in rows), key=key)


def test_rights(spark):
    acl = "user::rw-,user:bob:rwx,group::r--,group:dev:-wx,mask::rw-,other::---,default:user::rwx,default:group::r-x,default:other::---"
    def ask(who, groups, p):
        return one(spark, lifecycle.allows(F.lit(acl), F.lit("ann"), F.lit("staff"), F.lit(who), F.array(*map(F.lit, groups)).cast("array<string>"), p))
    assert [ask("ANN", [], "w"), ask("ann", [], "x"), ask("Bob", [], "w"), ask("bob", [], "x"), ask("eve", ["STAFF"], "r"), ask("eve", ["dev"], "w"), ask("eve", ["dev"], "x"), ask("eve", ["staff", "dev"], "w"), ask("eve", [], "r")] == [True, False, True, False, True, True, False, True, False]
    assert one(spark, lifecycle.mode(F.lit(acl))) == "rw-r-----" and one(spark, lifecycle.mode(F.lit("user::rwx,group::r-x,other::--x"), sticky=True)) == "rwxr-x--t"
    assert one(spark, lifecycle.inherited(F.lit(acl), F.lit(False))) == "user::rwx,group::r-x,other::---"
    assert one(spark, lifecycle.inherited(F.lit("user::rwx,group::r-x,other::--x"), F.lit(True))) is None


def test_targets_and_ancestors(spark):
    df = spark.createDataFrame([("b", None), ("b", "s")], "name string, snapshot string")
    assert [lifecycle.delete_targets(df, o).count() for o in (None, "include", "only")] == [1, 2, 1]
    names = spark.createDataFrame([("c", "x/y/z"), ("c", "w")], "container string, name string")
    there = spark.createDataFrame([("c", "x")], "container string, name string")
    assert [r["name"] for r in lifecycle.missing_ancestors(names, there).collect()] == ["x/y"]


def test_inventory(spark):
    refs = spark.createDataFrame([("a",), ("d/$zero",), ("a",)], "chunk_id string")
    assert [r[0] for r in inventory.reachable(refs, refs).collect()] == ["a"]
    assert inventory.same(refs, refs) and not inventory.same(refs, refs.distinct())
    assert inventory.still_referenced(refs.distinct(), refs).count() == 1


def test_min_and_max_of_text(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(["10", "9", "abc", "9.0", None, "b"])], "i int, t string")
    r = df.agg(aggregates.min_text(F.col("t"), F.col("i")).alias("lo"), aggregates.max_text(F.col("t"), F.col("i")).alias("hi")).first()
    assert (r["lo"], r["hi"]) == ("9", "b")
    assert str(one(spark, numeric_text(F.lit("1,234.5-"))["to_18"]))[:7] == "-1234.5"


def test_log_records(spark, tmp_path):
    df = spark.sql("select timestamp'2024-01-01 10:20:30.5' started_at, 'GetBlob' operation, 503 status_code, 12L e2e_ms, 'a;\"b\"' user_agent, 'oid' user_object_id")
    for version, width in (("1.0", 30), ("2.0", 38)):
        line = df.select(request_logs.record_line(df, version).alias("value"))
        r = request_logs.parsed(line).first()
        assert r["fault"] is None and (r["version"], r["operation"], r["status_code"], r["e2e_ms"], r["user_agent"]) == (version, "GetBlob", 503, 12, 'a;"b"')
        assert len(line.first()[0].replace("&quot;", "").replace('"a;b"', "ab").split(";")) == width
    assert request_logs.parsed(spark.createDataFrame([("1.0;x",)], "value string")).first()["fault"] == "1.0;x"
    df.select(request_logs.record_line(df)).write.text(str(tmp_path / "logs"))
    stream = hourly_logs.hourly(hourly_logs.log_stream(spark, str(tmp_path / "logs")))
    q = stream.writeStream.format("memory").queryName("hourly").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    r = spark.table("hourly").first()
    assert (str(r["hour"]), r["requests"], r["failures"]) == ("2024-01-01 10:00:00", 1, 1)


def test_operation_names(spark):
    ask = lambda *x: one(spark, request_logs.operation(*map(F.lit, x)))
    assert [ask("blob", "PUT", "", False), ask("blob", "PUT", "", True), ask("blob", "OPTIONS", "", False), ask("container", "HEAD", "acl", False), ask("blob", "PUT", "PAGE", True), ask("service", "PUT", "list", False)] == [
        "PutBlob", "CopyBlob", "PreflightBlobRequest", "GetContainerACL", "PutPageFromURL", "Unknown",
    ]
