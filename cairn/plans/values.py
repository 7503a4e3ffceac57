"""Queries of projections, filters, scalar functions and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import compare, hashing, json_path, logic, scalars
from ..operators import aggregates
from ..sources import records
from .derived import table
from .registry import query


@query("SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice AS amount FROM lineitem WHERE l_quantity > 49")
def q_project_filter(spark, sf):
    li = table(spark, sf, "lineitem").filter("l_quantity > 49")
    return li.select("l_orderkey", "l_linenumber", (F.col("l_quantity") * F.col("l_extendedprice")).alias("amount"))


@query("SELECT * FROM region WHERE r_name <> 'ASIA'")
def q_star_filter(spark, sf):
    return table(spark, sf, "region").filter("r_name <> 'ASIA'")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 25")
def q_limit_ordered(spark, sf):
    return table(spark, sf, "orders").filter("o_orderstatus = 'O'").orderBy("o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_partkey + l_suppkey AS a, l_partkey - l_suppkey AS b, l_partkey * 3 AS c, -l_partkey AS d, l_partkey % 7 AS e FROM lineitem")
def q_arith_long(spark, sf):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    rows = table(spark, sf, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", (p + s).alias("a"), (p - s).alias("b"), (p * 3).alias("c"), (-p).alias("d"), (p % 7).alias("e"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey <> 0 THEN l_partkey::DOUBLE / l_suppkey ELSE -1 END AS ratio, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def q_arith_double(spark, sf):
    rows = table(spark, sf, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", F.coalesce(scalars.divided(F.col("l_partkey"), F.col("l_suppkey")), F.lit(-1.0)).alias("ratio"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


@query("""WITH t AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders)
SELECT o_orderkey, NOT coalesce(s = 'O', false) AS not_open, coalesce(s IN ('O', 'F'), false) AS in_list, s IS NOT NULL AND NOT coalesce(s IN ('O'), false) AS not_in_list,
  s IS NULL AS unknown FROM t""")
def q_two_valued_logic(spark, sf):
    t = table(spark, sf, "orders").select("o_orderkey", scalars.null_if(F.col("o_orderstatus"), F.lit("P")).alias("s"))
    s = F.col("s")
    return t.select(
        "o_orderkey", logic.negated(s == "O").alias("not_open"), logic.is_in(s, F.lit("O"), F.lit("F"), F.lit(None)).alias("in_list"),
        logic.not_in(s, F.lit("O"), F.lit(None)).alias("not_in_list"), s.isNull().alias("unknown"),
    )


@query("""WITH t AS (SELECT o_orderkey, CASE WHEN o_custkey % 5 <> 0 THEN o_totalprice END AS p FROM orders)
SELECT o_orderkey, coalesce(p BETWEEN 1000 AND 50000, false) AS inside, p IS NOT NULL AND NOT coalesce(p BETWEEN 1000 AND 50000, false) AS outside FROM t""")
def q_between(spark, sf):
    p = F.when(F.col("o_custkey") % 5 != 0, F.col("o_totalprice"))
    t = table(spark, sf, "orders").select("o_orderkey", p.alias("p"))
    low, high = F.lit(1000.0), F.lit(50000.0)
    return t.select("o_orderkey", logic.between(F.col("p"), low, high).alias("inside"), logic.not_between(F.col("p"), low, high).alias("outside"))


@query("SELECT c_custkey, c_nationkey <> 0 AS by_number, c_mktsegment <> '' AS by_text, c_acctbal > 0 AS by_boolean FROM customer")
def q_truthiness(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", logic.truthy(F.col("c_nationkey"), "number").alias("by_number"), logic.truthy(F.col("c_mktsegment"), "text").alias("by_text"), logic.truthy(F.col("c_acctbal") > 0, "boolean").alias("by_boolean"))


@query("""SELECT p_partkey, trunc(cast(p_retailprice AS DOUBLE))::BIGINT AS from_number, trunc((p_retailprice::DECIMAL(18, 2))::DOUBLE)::BIGINT AS from_text,
  p_size::BIGINT AS whole, (p_size > 25)::BIGINT AS from_bool FROM part""")
def q_cast_int(spark, sf):
    p = table(spark, sf, "part")
    text = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    return p.select("p_partkey", scalars.to_int(F.col("p_retailprice"), "number").alias("from_number"), scalars.to_int(text).alias("from_text"), scalars.to_int(F.col("p_size").cast("string")).alias("whole"), scalars.to_int(F.col("p_size") > 25, "boolean").alias("from_bool"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS b, event_id % 4 = 3 AS bad FROM events")
def q_cast_bool(spark, sf):
    e = table(spark, sf, "events")
    text = F.element_at(F.array(F.lit("TRUE"), F.lit("0"), F.lit("2.5"), F.lit("yes")), (F.col("event_id") % 4 + 1).cast("int"))
    b = scalars.to_bool(text)
    return e.select("event_id", logic.holds(b).alias("b"), b.isNull().alias("bad"))


@query("SELECT p_partkey, p_size::VARCHAR AS whole, CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END AS flag, (p_size * 10)::VARCHAR AS shortest FROM part")
def q_cast_string(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.col("p_size").cast("string").alias("whole"), (F.col("p_partkey") % 2 == 0).cast("string").alias("flag"), scalars.number_text(F.col("p_size").cast("double") * 10).alias("shortest"))


@query("""SELECT event_id, epoch_us(date_trunc('day', ts)) AS day, epoch_us(date_trunc('month', ts)) AS month, epoch_us(ts) - 9000000000 AS ahead, true AS bad FROM events""")
def q_cast_timestamp(spark, sf):
    e, ts = table(spark, sf, "events"), F.col("ts")
    form = lambda f: F.date_format(ts, f)
    micros = lambda x: F.unix_micros(scalars.timestamp(x))
    return e.select(
        "event_id", micros(form("yyyy-MM-dd'T'")).alias("day"), micros(form("yyyy-MM'T'")).alias("month"),
        micros(form("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:30'")).alias("ahead"), micros(form("HH:mm:ss")).isNull().alias("bad"),
    )


@query("SELECT p_partkey, substr(p_name, 3, 4) AS part, substr(p_name, 2) AS rest, length(p_name)::INT AS n FROM part")
def q_substring0(spark, sf):
    p, name = table(spark, sf, "part"), F.col("p_name")
    return p.select("p_partkey", scalars.substring0(name, 2, 4).alias("part"), scalars.substring0(name, 1).alias("rest"), F.char_length(name).alias("n"))


@query("SELECT c_custkey, trim('  ' || c_name || chr(9), ' ' || chr(9)) AS spaces, rtrim(c_name, '0123456789') AS no_digits, ltrim(c_name, 'Cus') AS cut, upper(c_name) AS up, lower(c_name) AS low FROM customer")
def q_trim_case(spark, sf):
    c, name = table(spark, sf, "customer"), F.col("c_name")
    return c.select(
        "c_custkey", scalars.trim_space(F.concat(F.lit("  "), name, F.lit("\t"))).alias("spaces"), scalars.trim_set(name, "0123456789", "TRAILING").alias("no_digits"),
        scalars.trim_set(name, "Cus", "LEADING").alias("cut"), F.upper(name).alias("up"), F.lower(name).alias("low"),
    )


@query("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), nullif(o_orderpriority, '1-URGENT'), 'none') AS first_known FROM orders")
def q_coalesce_nullif(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.coalesce(scalars.null_if(F.col("o_orderstatus"), F.lit("O")), scalars.null_if(F.col("o_orderpriority"), F.lit("1-URGENT")), F.lit("none")).alias("first_known"))


@query("""SELECT event_id, ts + to_months(1) AS a_month, ts + to_years(-1) AS a_year, ts + to_days(3) AS days, ts + to_seconds(90) AS seconds, ts + to_microseconds(129600000000) AS fraction FROM events""")
def q_date_add(spark, sf):
    e, ts = table(spark, sf, "events"), F.col("ts").cast("timestamp")
    plain = lambda x: x.cast("timestamp_ntz")
    return e.select(
        "event_id", plain(scalars.date_add("month", F.lit(1), ts)).alias("a_month"), plain(scalars.date_add("years", F.lit(-1), ts)).alias("a_year"), plain(scalars.date_add("day", F.lit(3), ts)).alias("days"),
        plain(scalars.date_add("seconds", F.lit(90), ts)).alias("seconds"), plain(scalars.add_days(ts, F.lit(1.5))).alias("fraction"),
    )


@query("""WITH t AS (SELECT event_id, ts, TIMESTAMP '2023-12-31 23:59:59' AS base FROM events)
SELECT event_id, date_diff('year', base, ts) AS years, date_diff('month', base, ts) AS months, date_diff('day', base, ts) AS days, date_diff('hour', base, ts) AS hours,
  date_diff('minute', base, ts) AS minutes, date_diff('second', base, ts) AS seconds FROM t""")
def q_date_diff(spark, sf):
    e, ts = table(spark, sf, "events"), F.col("ts").cast("timestamp")
    base = F.lit("2023-12-31 23:59:59").cast("timestamp")
    return e.select("event_id", *[scalars.date_diff(u, base, ts).alias(u + "s") for u in ("year", "month", "day", "hour", "minute", "second")])


@query("""SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts + to_minutes(90)) AS h_local, minute(ts) AS mi, second(ts) AS s, strftime(ts, '%Y/%m/%d %H:%M:%S') AS said FROM events""")
def q_extract_to_string(spark, sf):
    e, ts = table(spark, sf, "events"), F.col("ts").cast("timestamp")
    return e.select(
        "event_id", scalars.extract("year", ts).alias("y"), scalars.extract("month", ts).alias("m"), scalars.extract("day", ts).alias("d"), scalars.extract("hour", ts, F.lit(90)).alias("h_local"),
        scalars.extract("minute", ts).alias("mi"), scalars.extract("second", ts).alias("s"), scalars.to_string(ts, "yyyy/MM/dd HH:mm:ss").alias("said"),
    )


@query("""SELECT count(*) AS n, count(nullif(l_returnflag, 'N')) AS known, sum(l_partkey)::BIGINT AS total, round(sum(l_extendedprice), 2) AS price, round(avg(l_quantity), 6) AS mean,
  min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'""")
def q_aggregates(spark, sf):
    li = table(spark, sf, "lineitem").filter("l_shipdate < timestamp_ntz '1996-01-01'")
    price = F.col("l_extendedprice")
    return li.agg(
        F.count(F.lit(1)).alias("n"), F.count(scalars.null_if(F.col("l_returnflag"), F.lit("N"))).alias("known"), aggregates.sum_long(F.col("l_partkey")).alias("total"),
        F.round(aggregates.sum_double(price), 2).alias("price"), F.round(aggregates.avg(F.col("l_quantity")), 6).alias("mean"), F.min(price).alias("low"), F.max(price).alias("high"),
    )


@query("SELECT count(*) AS n, sum(l_partkey) IS NULL AS no_total, avg(l_quantity) IS NULL AS no_mean, min(l_comment_like) IS NULL AS no_low FROM (SELECT *, l_returnflag AS l_comment_like FROM lineitem WHERE l_quantity < 0)")
def q_aggregate_empty(spark, sf):
    li = table(spark, sf, "lineitem").filter("l_quantity < 0")
    return li.agg(F.count(F.lit(1)).alias("n"), aggregates.sum_long(F.col("l_partkey")).isNull().alias("no_total"), aggregates.avg(F.col("l_quantity")).isNull().alias("no_mean"), F.min("l_returnflag").isNull().alias("no_low"))


@query("""WITH t AS (SELECT o_orderkey, (o_orderkey % 1000)::VARCHAR AS t FROM orders)
SELECT min_by(t, t::BIGINT) AS low, max_by(t, t::BIGINT) AS high FROM t""")
def q_min_max_text(spark, sf):
    t = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 1000).cast("string").alias("t"))
    return t.agg(aggregates.min_text(F.col("t"), F.col("o_orderkey")).alias("low"), aggregates.max_text(F.col("t"), F.col("o_orderkey")).alias("high"))


@query("""SELECT p_partkey, sign(p_size - 10)::INT AS numeric, CASE WHEN p_brand < 'Brand#3' THEN -1 WHEN p_brand = 'Brand#3' THEN 0 ELSE 1 END AS as_text FROM part""")
def q_compare_text(spark, sf):
    p = table(spark, sf, "part")
    size = F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".0"))
    return p.select("p_partkey", compare.compare_text(size, F.lit("1e1")).alias("numeric"), compare.compare_text(F.col("p_brand"), F.lit("Brand#3")).alias("as_text"))


@query("""SELECT l_orderkey, l_linenumber, sign(l_partkey::DECIMAL(38, 6) - (l_partkey::DECIMAL(38, 6) + l_linenumber - 3) - 0.5)::INT AS near,
  CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE 0 END AS far FROM lineitem""")
def q_compare_long_double(spark, sf):
    """Also beyond 2**53, where a cast to double would lose the difference."""
    li = table(spark, sf, "lineitem")
    near = compare.compare_long_double(F.col("l_partkey"), F.col("l_partkey").cast("double") + F.col("l_linenumber") - 2.5)
    far = compare.compare_long_double(F.lit(9007199254740992) + F.col("l_linenumber") % 2, F.lit(9007199254740992.0))
    return li.select("l_orderkey", "l_linenumber", near.alias("near"), far.alias("far"))


@query("""SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, NOT json_exists(props, '$.absent') AS missing, coalesce(json_type(props, '$.k') = 'NULL', false) AS is_null FROM events WHERE props IS NOT NULL""")
def q_json_path(spark, sf):
    e = table(spark, sf, "events").filter("props is not null").select("event_id", F.try_parse_json("props").alias("v"))
    v = F.col("v")
    return e.select("event_id", json_path.at(v, "$.k", "bigint").alias("k"), json_path.is_missing(v, "$.absent").alias("missing"), json_path.is_json_null(v, "$.k").alias("is_null"))


@query("""WITH t AS (SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events WHERE props IS NOT NULL)
SELECT event_id, unnest([k, k + 1, event_id % 3]) AS element FROM t WHERE event_id % 2 = 0""")
def q_json_wildcard(spark, sf):
    """Rows whose value at the path isn't an array vanish."""
    e = table(spark, sf, "events").filter("props is not null")
    k = F.get_json_object("props", "$.k").cast("bigint")
    said = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.array(k, k + 1, F.col("event_id") % 3).alias("a")))).otherwise('{"a": {"b": 1}}')
    rows = json_path.each(e.select("event_id", F.parse_json(said).alias("v")), "v", "$.a", "x")
    return rows.select("event_id", F.try_variant_get("x", "$", "bigint").alias("element"))


@query("SELECT doc_id, sha256(text) AS sha, md5(text) AS md FROM documents")
def q_content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md"))


@query("SELECT c_custkey, sha256(length(c_name) || ':' || c_name || ';-1:;' || length(c_mktsegment) || ':' || c_mktsegment || ';') AS fingerprint FROM customer")
def q_field_fingerprint(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", hashing.fingerprint(F.col("c_name"), F.lit(None).cast("string"), F.col("c_mktsegment")).alias("fingerprint"))


@query()
def q_content_crc64(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.hex(hashing.crc64(F.col("text").cast("binary"))).alias("crc64"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity, l_shipdate FROM lineitem")
def q_parquet_normalised(spark, sf):
    li = records.normalised(table(spark, sf, "lineitem"))
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS any_case, NOT json_exists(props, '$.K') AS absent FROM events WHERE props IS NOT NULL")
def q_json_any_case(spark, sf):
    e = table(spark, sf, "events").filter("props is not null").select("event_id", F.try_parse_json("props").alias("v"))
    return e.select("event_id", F.try_variant_get(json_path.member(F.col("v"), "K"), "$", "bigint").alias("any_case"), json_path.member(F.col("v"), "K", any_case=False).isNull().alias("absent"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN -1 ELSE 1 END AS exact FROM orders")
def q_compare_decimal_double(spark, sf):
    """0.5 is exact as a double, 0.1 is a little more than the decimal, 0.7 a little less."""
    k = (F.col("o_orderkey") % 3 + 1).cast("int")
    pick = lambda kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in ("0.5", "0.1", "0.7")]), k)
    return table(spark, sf, "orders").select("o_orderkey", compare.compare_decimal_double(pick("decimal(20,5)"), pick("double")).alias("exact"))
