"""Queries of listings, tag search, conditions, ranges, manifests, inventory, lifecycle and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conditions, inventory, lifecycle, listing, manifests, ranges, request_logs, tags
from ..sources import writers
from ..streaming import hourly_logs
from . import derived as d
from .registry import query

FLAT = "entry_name, entry_type, rank, version_id, snapshot, generation_id, is_uncommitted, is_directory"
ENTRY = "name AS entry_name, 1 AS entry_type, rank, version_id, snapshot, generation_id, is_uncommitted, is_directory"


def _eligible(source: str, container: str, where: str, snapshots: bool = False) -> str:
    return f"""SELECT name, version_id, snapshot, generation_id, CASE WHEN is_current THEN {4 if snapshots else 0} WHEN version_id IS NOT NULL THEN 1 WHEN snapshot IS NULL THEN 2 ELSE 3 END AS rank,
  0 AS is_uncommitted, is_directory::INT AS is_directory FROM {source} WHERE container = '{container}' AND {where}"""


@query(f"WITH {d.BLOBS}, e AS ({_eligible('blobs', 'en', 'is_current AND NOT is_deleted')}) SELECT {ENTRY} FROM e ORDER BY name LIMIT 50")
def q_list_flat(spark, sf):
    return listing.page(listing.entries(listing.eligible(d.blobs(spark, sf), "en")), 50)


@query(f"""WITH {d.BLOBS}, e AS ({_eligible('blobs', 'en', "is_current AND NOT is_deleted AND name LIKE 'src%'")}),
r AS (SELECT DISTINCT substr(name, 1, 3 + instr(substr(name, 4), '/')) AS entry_name FROM e)
SELECT entry_name, 0 AS entry_type, -1 AS rank, NULL::VARCHAR AS version_id, NULL::VARCHAR AS snapshot, '' AS generation_id, 0 AS is_uncommitted, 0 AS is_directory FROM r""")
def q_list_delimiter(spark, sf):
    rows = listing.eligible(d.blobs(spark, sf), "en", prefix="src")
    return listing.rolled_up(rows, "src", "/").orderBy(*listing.order())


@query(f"""WITH {d.VERSIONS}, e AS ({_eligible('versions', 'c', 'NOT is_deleted', True)})
SELECT {ENTRY} FROM e ORDER BY name, rank, CASE WHEN rank = 1 THEN version_id END DESC NULLS LAST, CASE WHEN rank = 3 THEN snapshot END NULLS FIRST, generation_id LIMIT 200""")
def q_list_versions(spark, sf):
    rows = listing.eligible(d.versions(spark, sf), "c", snapshots=True, versions=True)
    return listing.page(listing.entries(rows), 200)


CURSOR = {"entry_name": "cust/000000010", "entry_type": 1, "rank": 4, "generation_id": "", "version_id": None, "snapshot": None, "name_complete": False}


@query(f"""WITH {d.VERSIONS}, e AS ({_eligible('versions', 'c', 'true', True)})
SELECT {ENTRY} FROM e WHERE name > 'cust/000000010' OR (name = 'cust/000000010' AND (rank > 4 OR (rank = 4 AND generation_id > '')))
ORDER BY name, rank, CASE WHEN rank = 1 THEN version_id END DESC NULLS LAST, CASE WHEN rank = 3 THEN snapshot END NULLS FIRST, generation_id LIMIT 100""")
def q_list_keyset_page(spark, sf):
    rows = listing.eligible(d.versions(spark, sf), "c", snapshots=True, versions=True, deleted=True)
    text = listing.marker(CURSOR, {"container": "c"})
    return listing.page(listing.entries(rows), 100, listing.cursor_of(text, {"container": "c"}))


@query(f"""WITH {d.BLOBS}, e AS ({_eligible('blobs', 'en', "is_current AND NOT is_deleted AND name >= 'src1/' AND name < 'src3'")}) SELECT {ENTRY} FROM e""")
def q_list_bounds(spark, sf):
    rows = listing.eligible(d.blobs(spark, sf), "en", start_from="src1/", end_before="src3")
    return listing.entries(rows).orderBy(*listing.order())


@query(f"""WITH {d.BLOBS}, e AS ({_eligible('blobs', 'de', "is_current AND NOT is_deleted AND name LIKE 'src1%'")}),
c AS (SELECT *, instr(substr(name, 5), '/') AS o FROM e),
p AS (SELECT DISTINCT CASE WHEN o = 0 THEN name || '/' ELSE substr(name, 1, 4 + o) END AS entry_name FROM c WHERE is_directory = 1 OR o > 0)
SELECT entry_name, 0 AS entry_type, -1 AS rank, NULL::VARCHAR AS version_id, NULL::VARCHAR AS snapshot, '' AS generation_id, 0 AS is_uncommitted, 1 AS is_directory FROM p
UNION ALL SELECT {ENTRY} FROM c WHERE NOT (is_directory = 1 OR o > 0)""")
def q_list_directories(spark, sf):
    rows = listing.eligible(d.blobs(spark, sf), "de", prefix="src1", recursive=True)
    return listing.rolled_up(rows, "src1", "/", directories=True).orderBy(*listing.order(recursive=True))


@query(f"""WITH {d.BLOBS}, {d.STAGED} SELECT DISTINCT blob_name AS name FROM staged s WHERE NOT EXISTS (SELECT 1 FROM blobs b WHERE b.container = s.container AND b.name = s.blob_name AND b.is_current AND NOT b.is_deleted)""")
def q_list_uncommitted(spark, sf):
    return listing.uncommitted(d.blobs(spark, sf), d.staged(spark, sf)).select("name")


@query(f"WITH {d.VERSIONS} SELECT generation_id, is_current FROM versions WHERE name = 'cust/000000010'")
def q_object_family(spark, sf):
    return listing.family(d.versions(spark, sf).withColumn("last_modified", F.col("generation_id")), "c", "cust/000000010").select("generation_id", "is_current")


@query(f"WITH {d.BLOBS} SELECT container, name, lang || '|' || source AS tags FROM blobs WHERE NOT is_deleted AND lang = 'en' AND source >= 'src1' AND source < 'src15'")
def q_find_by_tags(spark, sf):
    own = tags.find(d.blobs(spark, sf), [tags.Tag("lang", "=", "en"), tags.Tag("source", ">=", "src1"), tags.Tag("source", "<", "src15")])
    return own.select("container", "name", F.concat_ws("|", F.col("tags")["lang"], F.col("tags")["source"]).alias("tags"))


@query(f"WITH {d.BLOBS} SELECT container, name FROM blobs WHERE NOT is_deleted AND lang = 'fr' AND source > 'src2'")
def q_find_by_tag_index(spark, sf):
    blobs = d.blobs(spark, sf)
    return tags.find_in_index(blobs, tags.index_of(blobs), [tags.Tag("lang", "=", "fr"), tags.Tag("source", ">", "src2")]).select("container", "name")


@query(f"WITH {d.BLOBS} SELECT container, name, lang <> 'en' AS other, false AS absent FROM blobs")
def q_tag_condition(spark, sf):
    t = F.col("tags")
    return d.blobs(spark, sf).select("container", "name", tags.condition(tags.Tag("lang", "<>", "en"), t).alias("other"), tags.condition(tags.Tag("none", "<>", "x"), t).alias("absent"))


@query(f"""WITH {d.BLOBS} SELECT name, CASE WHEN created_at > TIMESTAMP '2020-10-10 00:00:00' THEN 'precondition_failed' WHEN etag < 'x' AND NOT created_at > TIMESTAMP '2020-09-20 00:00:00' AND false THEN ''
  WHEN NOT (created_at > TIMESTAMP '2020-09-20 00:00:00') THEN 'not_modified' ELSE 'ok' END AS outcome FROM blobs""")
def q_conditions(spark, sf):
    at = lambda s: F.lit(s).cast("timestamp")
    own = conditions.read_outcome(F.concat(F.lit('"'), "etag", F.lit('"')), F.col("created_at"), if_match=["*"], modified_since=at("2020-09-20 00:00:00.9"), unmodified_since=at("2020-10-10 00:00:00.2"))
    return d.blobs(spark, sf).select("name", own.alias("outcome"))


@query(f"""WITH {d.BLOBS} SELECT name, CASE WHEN length > 100 THEN 100 END AS "start", CASE WHEN length > 100 THEN least(4095, length - 1) END AS "end" FROM blobs""")
def q_byte_range(spark, sf):
    own = conditions.byte_range(F.lit("bytes=100-4095"), F.col("length"))
    return d.blobs(spark, sf).select("name", own["start"].alias("start"), own["end"].alias("end"))


MERGE = """w AS (SELECT {g}, start, "end", max("end") OVER (PARTITION BY {g} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {t}),
i AS (SELECT *, sum(CASE WHEN start <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY {g} ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS n FROM w),
m AS (SELECT {g}, min(start) AS start, max("end") AS "end" FROM i GROUP BY {g}, n)"""


@query(f"WITH {d.RANGES}, {MERGE.format(g='grp', t='ranges')} SELECT * FROM m")
def q_ranges_merge(spark, sf):
    return ranges.merged(d.ranges(spark, sf), ["grp"])


#: Elementary pages make set operations on ranges plain in SQL.
PAGES = "pages_of AS (SELECT DISTINCT grp, l_linenumber = 1 AS cleared, unnest(range(start, \"end\" + 1, 512)) AS p FROM ranges)"


@query(f"""WITH {d.RANGES}, {PAGES}, t AS (SELECT grp, p AS start, p + 511 AS "end" FROM pages_of WHERE NOT cleared EXCEPT SELECT grp, p, p + 511 FROM pages_of WHERE cleared), {MERGE.format(g='grp', t='t')} SELECT * FROM m""")
def q_ranges_subtract(spark, sf):
    own = d.ranges(spark, sf)
    return ranges.subtracted(own.filter("l_linenumber <> 1"), own.filter("l_linenumber = 1"), ["grp"])


@query(f"""WITH {d.RANGES}, {PAGES}, t AS (SELECT grp, p AS start, p + 511 AS "end" FROM pages_of WHERE NOT cleared INTERSECT SELECT grp, p, p + 511 FROM pages_of WHERE cleared), {MERGE.format(g='grp', t='t')} SELECT * FROM m""")
def q_ranges_intersect(spark, sf):
    own = d.ranges(spark, sf)
    return ranges.intersected(own.filter("l_linenumber <> 1"), own.filter("l_linenumber = 1"), ["grp"])


@query(f"""WITH {d.RANGES} SELECT grp, greatest(start, 100000) AS start, least("end", 300000) AS "end" FROM ranges WHERE "end" >= 100000 AND start <= 300000""")
def q_ranges_clip(spark, sf):
    return ranges.clipped(d.ranges(spark, sf), F.lit(100000), F.lit(300000)).select("grp", "start", "end")


@query(f"""WITH {d.RANGES}, n AS (SELECT DISTINCT grp, unnest(range(start, "end" + 1, 512)) AS p FROM ranges WHERE l_linenumber <= 3), b AS (SELECT DISTINCT grp, unnest(range(start, "end" + 1, 512)) AS p FROM ranges WHERE l_linenumber >= 3),
r AS (SELECT DISTINCT grp, unnest(range(start, "end" + 1, 512)) AS p FROM ranges WHERE l_linenumber = 2),
k AS (SELECT grp, p, 'changed' AS kind FROM n WHERE NOT EXISTS (FROM b WHERE b.grp = n.grp AND b.p = n.p) OR EXISTS (FROM r WHERE r.grp = n.grp AND r.p = n.p)
  UNION ALL SELECT grp, p, 'cleared' FROM b WHERE NOT EXISTS (FROM n WHERE b.grp = n.grp AND b.p = n.p)),
t AS (SELECT grp, kind, p AS start, p + 511 AS "end" FROM k), {MERGE.format(g='grp, kind', t='t')} SELECT * FROM m""")
def q_ranges_diff(spark, sf):
    own = d.ranges(spark, sf)
    return ranges.diff(own.filter("l_linenumber <= 3"), own.filter("l_linenumber >= 3"), own.filter("l_linenumber = 2"), ["grp"])


@query(f"""WITH {d.RANGES}, p AS (SELECT grp, unnest(range(start, "end" + 1, 512)) AS p, seq FROM ranges), s AS (SELECT grp, p, max(seq) AS seq FROM p GROUP BY 1, 2),
t AS (SELECT grp, seq, p AS start, p + 511 AS "end" FROM s), {MERGE.format(g='grp, seq', t='t')} SELECT * FROM m""")
def q_ranges_last_writer(spark, sf):
    own = d.ranges(spark, sf).select("grp", "start", "end", "seq")
    return ranges.last_writer(own, ["grp"]).select("grp", "seq", "start", "end")


@query(f"""WITH {d.RANGES}, s AS (SELECT grp, "end" AS e, unnest(range(start, "end" + 1, 8192)) AS start FROM ranges) SELECT grp, start, least(start + 8191, e) AS "end" FROM s""")
def q_ranges_split(spark, sf):
    return ranges.split(d.ranges(spark, sf).select("grp", "start", "end"), 8192)


@query(f"""WITH {d.REFERENCES}, u AS (SELECT blob, ordinal, min(chunk_id) AS chunk_id, max(length) AS length FROM refs GROUP BY 1, 2)
SELECT blob, ordinal, chunk_id, length, coalesce(sum(length) OVER (PARTITION BY blob ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM u""")
def q_manifest_offsets(spark, sf):
    u = d.chunk_references(spark, sf).groupBy("blob", "ordinal").agg(F.min("chunk_id").alias("chunk_id"), F.max("length").alias("length"))
    return manifests.with_offsets(u, ["blob"], "ordinal")


@query(f"""WITH {d.REFERENCES}, u AS (SELECT blob, ordinal, min(chunk_id) AS chunk_id, max(length) AS length FROM refs GROUP BY 1, 2),
z AS (SELECT *, chunk_id % 3 = 0 AS zero FROM u), l AS (SELECT *, zero AND coalesce(lag(zero) OVER (PARTITION BY blob ORDER BY ordinal), false) AS goes_on FROM z),
r AS (SELECT *, sum((NOT goes_on)::INT) OVER (PARTITION BY blob ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS run FROM l)
SELECT blob, min(ordinal) AS ordinal, CASE WHEN bool_and(zero) THEN 0 ELSE min(chunk_id) END AS id, sum(length)::BIGINT AS length FROM r GROUP BY blob, run""")
def q_manifest_zero_runs(spark, sf):
    u = d.chunk_references(spark, sf).groupBy("blob", "ordinal").agg(F.min("chunk_id").alias("chunk_id"), F.max("length").alias("length"))
    z = u.select("blob", "ordinal", F.when(F.col("chunk_id") % 3 == 0, 0).otherwise(F.col("chunk_id")).alias("id"), "length")
    return manifests.zero_runs(z, ["blob"], "ordinal", F.col("id") == 0)


@query(f"""WITH {d.REFERENCES}, u AS (SELECT blob, ordinal, min(chunk_id) AS id, max(length) AS length FROM refs GROUP BY 1, 2),
o AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY blob ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM u)
SELECT blob, id, greatest(s, 10000) - 10000 AS "offset", least(s + length, 60000) - greatest(s, 10000) AS length, greatest(s, 10000) - s AS skip FROM o WHERE s < 60000 AND s + length > 10000""")
def q_manifest_slice(spark, sf):
    u = d.chunk_references(spark, sf).groupBy("blob", "ordinal").agg(F.min("chunk_id").alias("id"), F.max("length").alias("length"))
    own = manifests.sliced(manifests.with_offsets(u, ["blob"], "ordinal"), F.lit(10000), F.lit(60000))
    return own.select("blob", "id", "offset", "length", "skip")


@query("""WITH w AS (SELECT o_orderkey AS obj, unnest([1, 2, 3]) AS ordinal FROM orders),
c AS (SELECT l_orderkey AS obj, l_linenumber AS block_id, max_by(l_partkey, l_suppkey * 1000000 + l_partkey) AS p FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2),
s AS (SELECT l_orderkey AS obj, l_linenumber AS block_id, max_by(l_partkey, l_suppkey * 1000000 + l_partkey) AS p FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2)
SELECT w.obj, w.ordinal, coalesce(s.p, c.p, -1) AS content, coalesce(s.p, c.p) IS NULL AS fault FROM w LEFT JOIN c ON c.obj = w.obj AND c.block_id = w.ordinal LEFT JOIN s ON s.obj = w.obj AND s.block_id = w.ordinal""")
def q_blocklist_resolve(spark, sf):
    li = d.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("obj"), F.col("l_linenumber").alias("block_id"), F.col("l_partkey").alias("content"), (F.col("l_suppkey") * 1000000 + F.col("l_partkey")).alias("at"), "l_returnflag")
    wanted = d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("obj"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("ordinal"))
    wanted = wanted.withColumns({"block_id": F.col("ordinal"), "source": F.lit("Latest")})
    staged = li.filter("l_returnflag = 'N'").withColumnRenamed("at", "created_at")
    committed = li.filter("l_returnflag <> 'N'").withColumnRenamed("at", "ordinal")
    return manifests.resolved_blocks(wanted, staged, committed, ["obj"]).select("obj", "ordinal", F.coalesce("content", F.lit(-1)).alias("content"), "fault")


@query(f"WITH {d.REFERENCES} SELECT DISTINCT chunk_id FROM (SELECT chunk_id FROM refs UNION SELECT l_suppkey FROM lineitem WHERE l_linenumber = 4)")
def q_reachable_chunks(spark, sf):
    staged = d.table(spark, sf, "lineitem").filter("l_linenumber = 4").select(F.col("l_suppkey").alias("chunk_id"))
    return inventory.reachable(d.chunk_references(spark, sf), staged)


@query(f"WITH {d.REFERENCES}, {d.STORED} SELECT chunk_id FROM stored WHERE chunk_id NOT IN (SELECT chunk_id FROM refs)")
def q_garbage_chunks(spark, sf):
    return inventory.garbage(d.stored(spark, sf).select("chunk_id"), d.chunk_references(spark, sf))


@query(f"""WITH {d.BLOBS}, {d.STAGED}, {d.REFERENCES} SELECT (SELECT count(*) FROM blobs) AS objects, (SELECT sum(length)::BIGINT FROM blobs) AS bytes, (SELECT count(*) FROM staged) AS staged_blocks,
  (SELECT sum(length)::BIGINT FROM staged) AS staged_bytes, (SELECT count(DISTINCT chunk_id) FROM refs) AS reachable_chunks""")
def q_inventory_summary(spark, sf):
    return inventory.summary(d.blobs(spark, sf), d.staged(spark, sf), d.chunk_references(spark, sf))


@query(f"WITH {d.PACKED} SELECT pack_id, count(*) AS chunks, max(record_offset + record_length) AS bytes FROM packed GROUP BY 1")
def q_pack_stats(spark, sf):
    return inventory.packs(d.packed(spark, sf))


@query(f"""WITH {d.STORED}, {d.REFERENCES}, l AS (SELECT DISTINCT chunk_id FROM refs),
s AS (SELECT pack_id, sum(record_length)::BIGINT AS bytes, sum(CASE WHEN l.chunk_id IS NULL THEN record_length ELSE 0 END)::BIGINT AS dead_bytes FROM stored LEFT JOIN l USING (chunk_id) GROUP BY 1)
SELECT pack_id, bytes, dead_bytes, dead_bytes / bytes AS dead_ratio FROM s WHERE dead_bytes / bytes >= 0.3""")
def q_pack_compaction(spark, sf):
    return inventory.compactable(d.stored(spark, sf), d.chunk_references(spark, sf), 0.3)


@query(f"WITH {d.BLOBS} SELECT source AS category, count(*) AS files, sum(length)::BIGINT AS bytes FROM blobs GROUP BY 1")
def q_usage_by_category(spark, sf):
    return inventory.usage(d.blobs(spark, sf), F.col("tags")["source"])


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS verified, count(*) FILTER (o_orderstatus = 'O') AS missing, count(*) FILTER (o_orderstatus = 'P') AS corrupt, 0::BIGINT AS customerkey FROM orders")
def q_integrity_tallies(spark, sf):
    names = F.create_map(*[F.lit(x) for x in ("F", "Verified", "O", "Missing", "P", "Corrupt")])
    return inventory.by_status(d.table(spark, sf, "orders").select(names[F.col("o_orderstatus")].alias("status")))


NOW = "2021-01-01 00:00:00"


@query(f"""WITH {d.BLOBS} SELECT name, is_deleted AND created_at + INTERVAL 40 DAY <= TIMESTAMP '{NOW}' AS purge, coalesce(created_at + INTERVAL 60 DAY <= TIMESTAMP '{NOW}', false) AND doc_id % 9 <> 0 AS expired FROM blobs""")
def q_lifecycle_purge(spark, sf):
    own = d.blobs(spark, sf).withColumns({"delete_retention_until": F.lit(None).cast("timestamp"), "deleted_at": F.col("created_at"), "expires_at": F.col("created_at") + F.expr("interval 60 days"), "has_legal_hold": F.col("doc_id") % 9 == 0, "immutability_until": F.lit(None).cast("timestamp")})
    now = F.lit(NOW).cast("timestamp")
    return own.select("name", lifecycle.purge_due(now, 40).alias("purge"), lifecycle.expired(now).alias("expired"))


@query(f"""WITH {d.BLOBS} SELECT name, CASE WHEN length <= 131072 THEN 'Hot' WHEN created_at <= TIMESTAMP '{NOW}' - INTERVAL 90 DAY THEN 'Cold' WHEN created_at <= TIMESTAMP '{NOW}' - INTERVAL 30 DAY THEN 'Cool' ELSE 'Hot' END AS tier FROM blobs""")
def q_smart_tier(spark, sf):
    none = F.lit(None).cast("timestamp")
    own = d.blobs(spark, sf).withColumns({"smart_tier_last_accessed_at": none, "access_tier_changed_at": none})
    return own.select("name", lifecycle.smart_tier(F.lit(NOW).cast("timestamp")).alias("tier"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderdate <= TIMESTAMP '1997-01-01' THEN 'Broken' WHEN o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1997-01-01' THEN 'Expired'
  WHEN o_orderstatus = 'P' THEN 'Breaking' WHEN o_orderstatus = 'O' THEN 'Leased' ELSE 'Available' END AS state FROM orders""")
def q_lease_state(spark, sf):
    state = F.when(F.col("o_orderstatus") == "P", "Breaking").when(F.col("o_orderstatus") == "O", "Leased").otherwise("Available")
    at = F.col("o_orderdate").cast("timestamp")
    own = d.table(spark, sf, "orders").select("o_orderkey", state.alias("lease_state"), at.alias("lease_expires_at"), at.alias("lease_break_ends_at"))
    return own.select("o_orderkey", lifecycle.lease_state(F.lit("1997-01-01 00:00:00").cast("timestamp")).alias("state"))


@query(f"""WITH {d.BLOBS}, r AS (SELECT * FROM (VALUES ('a', 'en', ['src1', 'src2/'], TIMESTAMP '2020-09-14'), ('b', 'en', [], TIMESTAMP '2020-10-01'), ('c', 'fr', ['src3'], NULL)) r(rule_id, container, prefixes, since))
SELECT b.container, b.name, rule_id FROM blobs b JOIN r ON r.container = b.container WHERE NOT is_deleted AND (len(prefixes) = 0 OR len(list_filter(prefixes, lambda p: starts_with(b.name, p))) > 0) AND (since IS NULL OR created_at >= since)""")
def q_replication_rules(spark, sf):
    rows = [("a", "en", ["src1", "src2/"], "2020-09-14"), ("b", "en", [], "2020-10-01"), ("c", "fr", ["src3"], None)]
    rules = spark.createDataFrame(rows, "rule_id string, container string, prefixes array<string>, since string").withColumn("since", F.col("since").cast("timestamp"))
    return lifecycle.replication_matches(d.blobs(spark, sf), rules)


@query(f"""WITH {d.BLOBS} SELECT DISTINCT container, source AS name FROM blobs WHERE NOT is_deleted AND source < 'src5'""")
def q_active_descendants(spark, sf):
    blobs = d.blobs(spark, sf)
    directories = blobs.select("container", F.col("tags")["source"].alias("name")).distinct().filter("name < 'src5'")
    return lifecycle.has_descendants(blobs, directories)


ACL = "user::rwx,user:u1:rw-,group::r-x,group:g2:-w-,mask::r-x,other::--x"


@query("""WITH t AS (SELECT c_custkey, 'u' || (c_custkey % 4) AS who, 'g' || (c_custkey % 3) AS g FROM customer)
SELECT c_custkey, CASE WHEN who = 'u0' THEN true WHEN who = 'u1' THEN true WHEN g = 'g0' THEN true ELSE false END AS can_read,
  CASE WHEN who = 'u0' THEN true WHEN who = 'u1' THEN false ELSE false END AS can_write, 'rwxr-x--x' AS mode FROM t""")
def q_acl_allows(spark, sf):
    c = d.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("u"), (F.col("c_custkey") % 4).cast("string")).alias("who"), F.array(F.concat(F.lit("G"), (F.col("c_custkey") % 3).cast("string"))).alias("g"))
    ask = lambda p: lifecycle.allows(F.lit(ACL), F.lit("U0"), F.lit("g0"), F.col("who"), F.col("g"), p)
    return c.select("c_custkey", ask("r").alias("can_read"), ask("w").alias("can_write"), lifecycle.mode(F.lit(ACL)).alias("mode"))


@query(f"WITH {d.LOG} SELECT operation, count(*) AS requests, count(*) FILTER (status_code >= 500) AS failures, sum(e2e_ms)::BIGINT AS e2e_ms FROM log WHERE auth_type <> 'anonymous' OR status_code BETWEEN 200 AND 299 OR status_code = 304 OR status_code >= 500 GROUP BY 1")
def q_request_counters(spark, sf):
    own = d.log(spark, sf)
    return request_logs.counters(own.filter(request_logs.logged(F.col("auth_type"), F.col("status_code"))), ["operation"])


@query(f"WITH {d.LOG} SELECT date_trunc('hour', started_at) AS hour, operation, count(*) AS requests, count(*) FILTER (status_code >= 500) AS failures, sum(e2e_ms)::BIGINT AS e2e_ms FROM log GROUP BY 1, 2")
def q_request_log_hourly(spark, sf):
    own = hourly_logs.hourly(d.log(spark, sf))
    return own.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query(f"WITH {d.LOG} SELECT event_id::VARCHAR AS request_id, operation, status_code::BIGINT AS status_code, e2e_ms, started_at FROM log")
def q_request_log_records(spark, sf):
    own = d.log(spark, sf).withColumns({"request_id": F.col("event_id").cast("string"), "user_agent": F.lit('a "b";\n<c>')})
    rows = request_logs.parsed(own.select(request_logs.record_line(own).alias("value"))).filter("fault is null and user_agent = 'a \"b\"; <c>'")
    return rows.select("request_id", "operation", "status_code", "e2e_ms", F.col("started_at").cast("timestamp_ntz").alias("started_at"))


@query(f"WITH {d.LOG} SELECT strftime(started_at, '%Y/%m/%d/%H00') AS hour, max(event_id % 1000) + 1 AS next FROM log GROUP BY 1")
def q_log_next_number(spark, sf):
    names = d.log(spark, sf).select(writers.log_path(F.col("started_at").cast("timestamp"), F.col("event_id") % 1000).alias("name"))
    return writers.next_number(names)


@query(f"""WITH {d.LOG} SELECT event_id, CASE status_code WHEN 200 THEN 'GetBlob' WHEN 404 THEN 'CopyBlob' ELSE 'Unknown' END AS name, CASE status_code WHEN 200 THEN 'read' WHEN 404 THEN 'write' ELSE 'delete' END AS category FROM log""")
def q_request_classification(spark, sf):
    own, status = d.log(spark, sf), F.col("status_code")
    method = F.when(status == 200, "GET").when(status == 404, "PUT").otherwise("DELETE")
    comp = F.when(status == 503, "block").otherwise("")
    return own.select("event_id", request_logs.operation(F.lit("blob"), method, comp, status == 404).alias("name"), request_logs.category(method).alias("category"))


@query()
def q_content_chunks(spark, sf):
    return manifests.chunks(d.table(spark, sf, "documents"), "doc_id", "text", 256, 1024, 4096)


@query("""SELECT 'requests_total{operation="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type""")
def q_metrics_text(spark, sf):
    return writers.metrics_text(request_logs.counters(d.log(spark, sf), ["operation"]), "requests_total", "requests", ["operation"])


@query(f"""SELECT o_orderkey, CASE WHEN o_orderdate + INTERVAL 10 DAY <= TIMESTAMP '1997-01-01' AND o_orderkey % 30 > 10 THEN 'failed' WHEN o_orderdate + to_days((o_orderkey % 30)::INT) <= TIMESTAMP '1997-01-01' THEN 'success' ELSE 'pending' END AS copy,
  CASE WHEN o_orderdate <= TIMESTAMP '1996-06-01' AND o_orderstatus = 'F' THEN 'Cool' ELSE 'Archive' END AS tier FROM orders""")
def q_due_copies(spark, sf):
    at, none = F.col("o_orderdate").cast("timestamp"), F.lit(None).cast("string")
    o = d.table(spark, sf, "orders").select(
        "o_orderkey", F.lit("pending").alias("copy_status"), (at + F.expr("interval 10 days")).alias("copy_expires_at"), (at + F.make_dt_interval((F.col("o_orderkey") % 30).cast("int"))).alias("copy_ready_at"),
        F.when(F.col("o_orderstatus") == "F", "rehydrate-pending-to-cool").alias("archive_status"), at.alias("rehydrate_complete_at"), F.lit("Archive").alias("access_tier"),
    )
    tier = lifecycle.tier_after_rehydration(F.lit("1996-06-01").cast("timestamp"))
    return o.withColumn("copy", lifecycle.copy_state(F.lit("1997-01-01").cast("timestamp"))).withColumn("copy_status", none).select("o_orderkey", "copy", tier.alias("tier"))


@query("SELECT c_custkey, c_acctbal < 0 AND TIMESTAMP '2024-01-01' + to_days((c_custkey % 60)::INT) + INTERVAL 7 DAY <= TIMESTAMP '2024-02-01' AS purge FROM customer")
def q_container_purge(spark, sf):
    deleted = F.when(F.col("c_acctbal") < 0, F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("c_custkey") % 60).cast("int")))
    c = d.table(spark, sf, "customer").select("c_custkey", deleted.alias("deleted_at"), F.lit(None).cast("timestamp").alias("delete_retention_until"))
    return c.select("c_custkey", lifecycle.container_purge_due(F.lit("2024-02-01").cast("timestamp"), 7).alias("purge"))


@query("""WITH r AS (SELECT DISTINCT url AS path FROM (SELECT CASE page_id % 3 WHEN 0 THEN 'dir' || (page_id % 7) || '/' WHEN 1 THEN 'page' || page_id ELSE '' END AS url FROM pages)),
o AS (SELECT DISTINCT 'page' || page_id AS name FROM pages WHERE page_id % 2 = 0 UNION SELECT 'dir1/index.html' UNION SELECT 'dir2/index.html' UNION SELECT '404.html')
SELECT path, coalesce(o.name, '404.html') AS name, CASE WHEN o.name IS NULL THEN 404 ELSE 200 END AS status FROM r LEFT JOIN o ON o.name = CASE WHEN path = '' OR path LIKE '%/' THEN path || 'index.html' ELSE path END""")
def q_site_pages(spark, sf):
    k = F.col("page_id")
    pages = d.table(spark, sf, "pages")
    path = F.when(k % 3 == 0, F.concat(F.lit("dir"), (k % 7).cast("string"), F.lit("/"))).when(k % 3 == 1, F.concat(F.lit("page"), k.cast("string"))).otherwise("")
    objects = pages.filter("page_id % 2 = 0").select(F.concat(F.lit("page"), k.cast("string")).alias("name"))
    objects = objects.unionByName(spark.createDataFrame([("dir1/index.html",), ("dir2/index.html",), ("404.html",)], "name string"))
    return listing.site_pages(pages.select(path.alias("path")).distinct(), objects, "index.html", error="/404.html")


@query(f"""WITH {d.BLOBS} SELECT container, name, 'source' AS tag_key, source AS tag_value, 'missing' AS fault FROM blobs WHERE source = 'src3' UNION ALL SELECT 'xx', 'none', 'k', 'v', 'surplus'""")
def q_tag_index_faults(spark, sf):
    blobs = d.blobs(spark, sf)
    index = tags.index_of(blobs).filter("not (tag_key = 'source' and tag_value = 'src3')")
    return tags.index_faults(blobs, index.unionByName(spark.createDataFrame([("xx", "none", "k", "v")], "container string, name string, tag_key string, tag_value string")))


@query(f"""WITH {d.REFERENCES}, u AS (SELECT blob, ordinal, min(chunk_id) AS id, max(length) AS length FROM refs GROUP BY 1, 2),
o AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY blob ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM u)
SELECT blob, id, s AS "offset", least(s + length, 30000) - s AS length, 0::BIGINT AS skip FROM o WHERE s < 30000
UNION ALL SELECT blob, id, greatest(s, 50000), s + length - greatest(s, 50000), greatest(s, 50000) - s FROM o WHERE s + length > 50000
UNION ALL SELECT DISTINCT blob, -1, 30000, 20000, 0 FROM o""")
def q_manifest_replace(spark, sf):
    refs = d.chunk_references(spark, sf)
    u = refs.groupBy("blob", "ordinal").agg(F.min("chunk_id").alias("id"), F.max("length").alias("length"))
    own = manifests.with_offsets(u, ["blob"], "ordinal").withColumn("skip", F.lit(0).cast("bigint"))
    n = lambda v: F.lit(v).cast("bigint")
    patch = u.select("blob").distinct().select("blob", n(-1).alias("id"), n(30000).alias("offset"), n(20000).alias("length"), n(0).alias("skip"))
    return manifests.replaced(own, patch, ["blob"])
