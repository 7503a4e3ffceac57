"""Queries of listings in directory mode, paths of several steps, numbers as text, and further operators of the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import compare, json_path, scalars
from ..operators import aggregates, conditions, lifecycle, listing, manifests, ranges, request_logs, tags
from ..sources import writers
from . import derived as d
from .registry import query
from .values import table

POWERS = [1e-6, 1e-5, 1.5e-5, 1e-4, 0.1, 1e6, 12345678.0, 1e14, 1e15, 1.5e20, 1e100]
POWER_TEXTS = "['1E-06', '1E-05', '0.000015', '0.0001', '0.1', '1000000', '12345678', '100000000000000', '1E+15', '1.5E+20', '1E+100']"


@query(f"""SELECT p_partkey, rtrim(rtrim(((p_partkey * 1000 + p_size) / 64.0)::DECIMAL(38, 6)::VARCHAR, '0'), '.') AS plain, {POWER_TEXTS}[p_partkey % 11 + 1] AS power FROM part""")
def q_number_text(spark, sf):
    k = F.col("p_partkey")
    x = (k * 1000 + F.col("p_size")).cast("double") / 64
    power = F.element_at(F.array(*map(F.lit, POWERS)), (k % len(POWERS) + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", scalars.number_text(x).alias("plain"), scalars.number_text(power).alias("power"))


@query("""WITH t AS (SELECT p_partkey, p_partkey::HUGEINT * CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000000000000000::HUGEINT ELSE 10000000000000000000000::HUGEINT END AS a,
  p_size::HUGEINT * CASE p_size % 2 WHEN 0 THEN 10000000000::HUGEINT ELSE 1000000000000000000000::HUGEINT END AS b FROM part)
SELECT p_partkey, sign(a::DECIMAL(38, 0) - b::DECIMAL(38, 0))::INT AS whole, 1 AS tiny FROM t""")
def q_compare_large_text(spark, sf):
    """Numbers as text from 1 to 10^27, with exponents; and two that differ in the 27th digit after the point."""
    k, size = F.col("p_partkey"), F.col("p_size")
    a = F.concat(k.cast("string"), F.when(k % 3 == 0, "").when(k % 3 == 1, "e15").otherwise("0000000000000000000000"))
    b = F.concat(size.cast("string"), F.when(size % 2 == 0, "0000000000").otherwise("E+21"))
    tiny = compare.compare_text(F.concat(F.lit("0.00000000000000000"), F.lpad((k + 1).cast("string"), 10, "0")), F.concat(F.lit("0.00000000000000000"), F.lpad(k.cast("string"), 10, "0")))
    return table(spark, sf, "part").select("p_partkey", compare.compare_text(a, b).alias("whole"), tiny.alias("tiny"))


@query("""SELECT sum(CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice::DECIMAL(18, 2) END)::DOUBLE AS total, count(*) FILTER (o_orderkey % 7 = 0) AS faults,
  round(avg(CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice::DECIMAL(18, 2)::DOUBLE END), 4) AS mean FROM orders""")
def q_sum_text(spark, sf):
    """Rows whose text is no number are left out and counted."""
    text = F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    t = table(spark, sf, "orders").select(text.alias("t"))
    x = F.col("t")
    return t.agg(aggregates.sum_text(x).cast("double").alias("total"), aggregates.faults(x).alias("faults"), F.round(aggregates.avg_text(x), 4).alias("mean"))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS price, o_orderkey % 3 = 0 AS bad FROM orders")
def q_cast_float(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return o.select("o_orderkey", F.round(scalars.to_float(price), 2).alias("price"), scalars.to_float(F.when(k % 3 == 0, "1e999").when(k % 3 == 1, " 1e3 ").otherwise("-.5")).isNull().alias("bad"))


@query("""WITH t AS (SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events WHERE props IS NOT NULL), u AS (SELECT event_id, unnest([k, k + 1]) AS v FROM t)
SELECT event_id, v AS first, v * 2 AS second FROM u""")
def q_json_steps(spark, sf):
    """A path of several steps - any-case name, wildcard, exact name, index - and the row of the array found."""
    e = table(spark, sf, "events").filter("props is not null")
    k = F.get_json_object("props", "$.k").cast("bigint")
    item = lambda x: F.struct(F.array(F.array(x - x), F.array(x, x * 2)).alias("Inner"))
    said = F.to_json(F.struct(F.array(item(k), item(k + 1)).alias("Items"), F.lit(1).alias("other")))
    rows = json_path.expanded(e.select("event_id", F.parse_json(said).alias("v")), "v", ["iTEMS", "*", ("Inner",), 1], "x")
    of = lambda name: F.try_variant_get(json_path.column_of(F.col("x"), name), "$", "bigint")
    return rows.select("event_id", of("_1").alias("first"), of("_2").alias("second"))


DIRECTORY = """b AS (SELECT container, CASE WHEN doc_id % 5 = 0 THEN source ELSE name END AS name, is_deleted, doc_id % 5 = 0 AS is_directory, etag FROM blobs)"""


def _with_directories(spark, sf):
    folder = F.col("doc_id") % 5 == 0
    return d.blobs(spark, sf).withColumns({"name": F.when(folder, F.col("tags")["source"]).otherwise(F.col("name")), "is_directory": folder})


@query(f"""WITH {d.BLOBS}, {DIRECTORY}, e AS (SELECT * FROM b WHERE container = 'en' AND NOT is_deleted),
p AS (SELECT DISTINCT CASE WHEN instr(name, '/') = 0 THEN name || '/' ELSE substr(name, 1, instr(name, '/')) END AS entry_name FROM e WHERE is_directory OR instr(name, '/') > 0)
SELECT entry_name, (SELECT max(etag) FROM e WHERE is_directory AND e.name || '/' = entry_name) AS etag FROM p""")
def q_list_directory_properties(spark, sf):
    blobs = _with_directories(spark, sf)
    rolled = listing.rolled_up(listing.eligible(blobs, "en", recursive=True), "", "/", directories=True)
    return listing.directory_properties(rolled, blobs, "en", F.col("etag")).select("entry_name", F.col("data").alias("etag"))


@query(f"""WITH {d.BLOBS} SELECT name, CASE WHEN is_deleted THEN 'deleted' WHEN is_directory THEN 'directories' ELSE 'files' END AS shown FROM blobs""")
def q_list_show_only(spark, sf):
    blobs = d.blobs(spark, sf)
    kinds = [blobs.filter(listing.visible_in_directories(show_only=k)).select("name", F.lit(k).alias("shown")) for k in ("deleted", "files", "directories")]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


@query("""SELECT l_orderkey, l_linenumber, created_at FROM (SELECT l_orderkey, l_linenumber, min(l_shipdate) AS created_at FROM lineitem GROUP BY 1, 2) WHERE created_at < TIMESTAMP '1996-01-01'
ORDER BY created_at, l_orderkey, l_linenumber LIMIT 500""")
def q_stale_blocks(spark, sf):
    """The limit is the feature: a bounded step of an expiry."""
    own = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("created_at"))
    staged = own.withColumns({"container": F.lit("c"), "blob_name": F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), "block_id": F.col("l_linenumber")})
    return listing.stale_blocks(staged, F.lit("1996-01-01").cast("timestamp_ntz"), 500).select("l_orderkey", "l_linenumber", "created_at")


@query(f"""WITH {d.BLOBS} SELECT container, name FROM blobs WHERE NOT is_deleted AND source >= 'src1' AND (container > 'de' OR (container = 'de' AND name > 'src2')) ORDER BY container, name LIMIT 100""")
def q_find_by_tags_page(spark, sf):
    return tags.found_after(tags.find(d.blobs(spark, sf), [tags.Tag("source", ">=", "src1")]), "de", "src2", 100).select("container", "name")


@query("SELECT name FROM (SELECT DISTINCT source AS name FROM documents) WHERE starts_with(name, 'src') AND name > 'src1' ORDER BY name LIMIT 11")
def q_container_list(spark, sf):
    own = table(spark, sf, "documents").select(F.col("source").alias("name"), F.lit(False).alias("deleted")).distinct()
    return listing.containers(own, "src", "src1", 10).select("name")


@query("SELECT l_suppkey AS grp, l_orderkey <= 1000 AS at_most, l_orderkey < 1000 AND l_orderkey = l_linenumber AS both, l_orderkey AS seq, l_linenumber FROM lineitem")
def q_sequence_conditions(spark, sf):
    seq = F.col("l_orderkey")
    at_most, both = conditions.sequence_holds(seq, at_most=F.lit(1000)), conditions.sequence_holds(seq, below=F.lit(1000), equal=F.col("l_linenumber"))
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("grp"), at_most.alias("at_most"), both.alias("both"), seq.alias("seq"), "l_linenumber")


@query("SELECT p_partkey, p_partkey % 3 <> 0 AS good FROM part")
def q_tag_components(spark, sf):
    said = F.when(F.col("p_partkey") % 3 == 0, "a*b").otherwise(F.concat(F.lit("k-"), F.col("p_partkey").cast("string")))
    return table(spark, sf, "part").select("p_partkey", tags.valid_component(said, 1, 128).alias("good"))


@query(f"""WITH {d.BLOBS} SELECT DISTINCT container, source AS name FROM blobs WHERE source >= 'src2'""")
def q_missing_ancestors(spark, sf):
    blobs = d.blobs(spark, sf)
    there = blobs.select("container", F.col("tags")["source"].alias("name")).distinct().filter("name < 'src2'")
    return lifecycle.missing_ancestors(blobs.select("container", "name"), there)


@query(f"""WITH {d.VERSIONS} SELECT 'base' AS option, generation_id FROM versions WHERE snapshot IS NULL UNION ALL SELECT 'only', generation_id FROM versions WHERE snapshot IS NOT NULL""")
def q_delete_targets(spark, sf):
    own = d.versions(spark, sf)
    pick = lambda name, option: lifecycle.delete_targets(own, option).select(F.lit(name).alias("option"), "generation_id")
    return pick("base", None).unionByName(pick("only", "only"))


@query(f"""WITH {d.STAGED}, {d.REFERENCES} SELECT blob::VARCHAR AS name, 'committed' AS state, ordinal, chunk_id AS block_id, length FROM refs
UNION ALL SELECT blob_name, 'uncommitted', NULL, block_id, length FROM staged""")
def q_block_lists(spark, sf):
    committed = d.chunk_references(spark, sf).select(F.col("blob").cast("string").alias("name"), "ordinal", F.col("chunk_id").alias("block_id"), "length")
    staged = d.staged(spark, sf).select(F.col("blob_name").alias("name"), "block_id", "length")
    return manifests.block_list(committed, staged)


@query("SELECT event_id, ts + INTERVAL 30 DAY <= TIMESTAMP '2024-02-15' AS expired FROM events")
def q_log_retention(spark, sf):
    own = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("created_at"))
    return own.select("event_id", lifecycle.log_expired(F.lit("2024-02-15").cast("timestamp"), 30).alias("expired"))


@query(f"""WITH {d.RANGES} SELECT start, max("end") AS "end" FROM ranges GROUP BY start ORDER BY start LIMIT 50 OFFSET 20""")
def q_range_pages(spark, sf):
    """A page of ranges; the limit is the feature."""
    return ranges.listed(d.ranges(spark, sf).groupBy("start").agg(F.max("end").alias("end")), 20, 50)


@query(f"""WITH {d.REFERENCES}, u AS (SELECT blob, ordinal, min(chunk_id) AS id, max(length) AS length FROM refs GROUP BY 1, 2),
o AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY blob ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM u)
SELECT blob, id, s AS "offset", least(length, 80000 - s) AS length, 0::BIGINT AS skip FROM o WHERE s < 80000
UNION ALL SELECT blob, 0, max(s + length), 80000 - max(s + length), 0 FROM o GROUP BY blob HAVING max(s + length) < 80000""")
def q_manifest_resize(spark, sf):
    u = d.chunk_references(spark, sf).groupBy("blob", "ordinal").agg(F.min("chunk_id").alias("id"), F.max("length").alias("length"))
    own = manifests.with_offsets(u, ["blob"], "ordinal").withColumn("skip", F.lit(0).cast("bigint"))
    return manifests.resized(own, ["blob"], F.lit(80000).cast("bigint"), F.lit(0).cast("bigint"))


@query("""SELECT 0 AS place, 'c_custkey,c_name' AS line UNION ALL SELECT 1, c_custkey || ',' || c_name FROM customer""")
def q_delimited_lines(spark, sf):
    return writers.delimited_lines(table(spark, sf, "customer").select("c_custkey", "c_name"))


@query("""SELECT event_id, ['AcquireBlobLease', 'LeaseContainer', 'SetBlobTier', 'GetAccountInformation', 'PutBlockFromURL', 'SnapshotBlob', 'Unknown', 'GetBlob', 'BreakContainerLease', 'PreflightBlobRequest'][event_id % 10 + 1] AS name FROM events""")
def q_operation_names(spark, sf):
    cases = [
        ("blob", "PUT", "lease", False, "ACQUIRE", False), ("container", "PUT", "lease", False, "other", False), ("blob", "PUT", "tier", False, None, False), ("service", "GET", "properties", False, None, True), ("blob", "PUT", "block", True, None, False),
        ("blob", "PUT", "snapshot", False, None, False), ("container", "PUT", "tier", False, None, False), ("website", "GET", "", False, None, False), ("container", "PUT", "lease", False, "break", False), ("blob", "OPTIONS", "", False, None, False),
    ]
    pick = lambda k, kind: F.element_at(F.array(*[F.lit(c[k]).cast(kind) for c in cases]), (F.col("event_id") % len(cases) + 1).cast("int"))
    name = request_logs.operation(pick(0, "string"), pick(1, "string"), pick(2, "string"), pick(3, "boolean"), pick(4, "string"), pick(5, "boolean"))
    return table(spark, sf, "events").select("event_id", name.alias("name"))
