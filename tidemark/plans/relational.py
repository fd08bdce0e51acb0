"""Inventory P, J, G, W, U over the star-schema tables and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from .registry import Tables, query

c = F.col


@query("p1_optional_filters", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def p1(t: Tables):
    found = R.optional_filters(t.orders, {"o_orderstatus": "F", "o_orderpriority": "1-URGENT", "o_custkey": None})
    return R.page(found, [F.desc("o_orderdate"), "o_orderkey"], 40, 20).select("o_orderkey", "o_orderpriority")


@query("p2_contains", "SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(p_type), 'an')")
def p2(t: Tables):
    return R.contains_any(t.part, "aN", ["p_name", "p_type"]).select("p_partkey", "p_name", "p_type")


@query("p3_json_containment", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def p3(t: Tables):
    return R.json_contains(t.events, "props", {"k": "7"}).select("event_id")


@query("p4_membership", "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'signup')")
def p4(t: Tables):
    return R.member_of(t.events, "event_type", ["error", "signup"]).select("event_id", "event_type")


@query("p5_ordinal", "SELECT event_id, event_type, coalesce(nullif(list_position(['error', 'purchase', 'signup'], event_type), 0), 4)::INT AS pos FROM events")
def p5(t: Tables):
    return t.events.select("event_id", "event_type", R.ordinal("event_type", ["error", "purchase", "signup"]).cast("int").alias("pos"))


@query(
    "p6_public_projection",
    "SELECT c_custkey, c_name, array_to_string(list_filter([CASE WHEN c_acctbal < 0 THEN 'negative balance' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'segment under review' END], lambda x: x IS NOT NULL), ';') AS notes FROM customer",
)
def p6(t: Tables):
    notes = {"neg": (c("c_acctbal") < 0, "negative balance"), "seg": (c("c_mktsegment") == "BUILDING", "segment under review")}
    return R.public_projection(t.customer, ["c_custkey", "c_name"], notes).select("c_custkey", "c_name", F.array_join("limitations", ";").alias("notes"))


@query("p7_null_defaults", "SELECT event_id, coalesce(json_extract_string(props, '$.none'), 'absent') AS missing, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 0 ELSE 1 END AS n_props FROM events")
def p7(t: Tables):
    maps = t.events.withColumn("m", F.from_json("props", "map<string,string>")).withColumn("missing", F.get_json_object("props", "$.none"))
    return R.filled(maps, {"missing": "absent"}).select("event_id", "missing", F.coalesce(F.size(R.without_null_entries("m")), F.lit(0)).alias("n_props"))


@query("p9_safe_metadata", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def p9(t: Tables):
    m = R.safe_metadata(F.from_json("props", "map<string,string>"), ["k"])
    return t.events.select("event_id", m["k"].alias("k"))


@query(
    "j1_star_join",
    "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'P'",
)
def j1(t: Tables):
    dims = [(t.customer, "o_custkey", "c_custkey"), (t.nation, "c_nationkey", "n_nationkey"), (t.region, "n_regionkey", "r_regionkey")]
    return R.star(t.orders.where("o_orderstatus = 'P'"), dims).select("o_orderkey", "c_name", "n_name", "r_name")


@query(
    "j2_left_join_defaults",
    "SELECT c_custkey, coalesce(n, 0)::BIGINT AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey",
)
def j2(t: Tables):
    n = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return R.star(t.customer, [(n, "c_custkey", "o_custkey")], "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("j3_semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def j3(t: Tables):
    return R.exists(t.customer.select("c_custkey"), t.orders.where("o_totalprice > 300000").select(c("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("j4_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def j4(t: Tables):
    pending = t.orders.where("o_orderstatus = 'P'").select(c("o_custkey").alias("c_custkey"))
    return R.not_exists(t.customer.select("c_custkey"), pending, ["c_custkey"])


@query(
    "j5_range_exclusions",
    """SELECT l_orderkey, l_linenumber FROM (SELECT *, [17, p_size, l_linenumber::BIGINT] AS v FROM lineitem JOIN part ON l_partkey = p_partkey) d
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE [17, 10::BIGINT] END AS vmin, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE [17, 30::BIGINT] END AS vmax,
      CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE 'R' END AS f FROM part WHERE p_partkey % 4 <> 0) x
      WHERE x.k = d.l_partkey AND (vmin IS NULL OR d.v >= vmin) AND (vmax IS NULL OR d.v <= vmax) AND (f IS NULL OR f = d.l_returnflag))""",
)
def j5(t: Tables):
    d = t.lineitem.join(t.part, c("l_partkey") == c("p_partkey")).withColumn("v", F.array(F.lit(17).cast("long"), c("p_size").cast("long"), c("l_linenumber").cast("long")))
    k = c("p_partkey")
    x = t.part.where("p_partkey % 4 <> 0").select(
        k.alias("l_partkey"), F.when(k % 3 != 0, F.expr("array(17L, 10L)")).alias("vmin"), F.when(k % 5 != 0, F.expr("array(17L, 30L)")).alias("vmax"), F.when(k % 2 != 0, F.lit("R")).alias("l_returnflag")
    )
    return R.not_excluded(d.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "v"), x, "l_partkey", "v", ["l_returnflag"]).select("l_orderkey", "l_linenumber")


@query(
    "j6_scope_disjunction",
    """SELECT s_suppkey, c_custkey FROM supplier q JOIN (SELECT *, CASE c_custkey % 3 WHEN 0 THEN 'any' WHEN 1 THEN 'nation' ELSE 'size' END AS scope_level, c_custkey % 7 AS size FROM customer) r
    ON q.s_suppkey % 100 = r.c_custkey % 100 AND (scope_level = 'any' OR (scope_level = 'nation' AND s_nationkey = c_nationkey) OR (scope_level = 'size' AND s_suppkey % 7 = size))""",
)
def j6(t: Tables):
    q = t.supplier.select("s_suppkey", (c("s_suppkey") % 100).alias("family"), c("s_nationkey").alias("nation"), (c("s_suppkey") % 7).alias("size"))
    k = c("c_custkey") % 3
    r = t.customer.select("c_custkey", (c("c_custkey") % 100).alias("family"), c("c_nationkey").alias("nation"), (c("c_custkey") % 7).alias("size"), F.when(k == 0, "any").when(k == 1, "nation").otherwise("size").alias("scope_level"))
    return R.by_scope(q, r, "family", {"nation": "nation", "size": "size"}).select("s_suppkey", "c_custkey")


@query(
    "j7_latest_per_row",
    "SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) x ON true",
)
def j7(t: Tables):
    inner = t.orders.select(c("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", "o_totalprice")
    return R.latest_per(t.customer.select("c_custkey"), inner, "c_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])


@query("j8_aggregate_per_row", "SELECT p_partkey, n, qty FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, max(l_quantity) AS qty FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def j8(t: Tables):
    return R.aggregate_per(t.part.select("p_partkey"), t.lineitem.withColumnRenamed("l_partkey", "p_partkey"), "p_partkey", n=F.count("*"), qty=F.max("l_quantity"))


@query("j9_scalar_counters", "SELECT count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, count(DISTINCT user_id) AS users, max(ts) AS last FROM events")
def j9(t: Tables):
    return R.counters(t.events, n=F.count("*"), errors=F.count_if(c("event_type") == "error"), users=F.countDistinct("user_id"), last=F.max("ts"))


@query("j10_settings", "SELECT event_id, datediff('day', ts, TIMESTAMP '2024-02-01')::INT AS age, 30 AS keep_days FROM events")
def j10(t: Tables):
    return R.with_settings(t.events, keep_days=30).select("event_id", F.date_diff(F.lit("2024-02-01").cast("date"), F.to_date("ts")).alias("age"), "keep_days")


@query("j11_two_sided_edges", "SELECT n_nationkey, r AS other, side FROM nation JOIN (SELECT l AS k, r, 'left' AS side FROM e UNION ALL SELECT r, l, 'right' FROM e) x ON n_nationkey = k".replace(" e ", " (SELECT s_nationkey AS l, s_suppkey % 25 AS r FROM supplier) e ").replace("FROM e)", "FROM (SELECT s_nationkey AS l, s_suppkey % 25 AS r FROM supplier) e)"))
def j11(t: Tables):
    e = t.supplier.select(c("s_nationkey").cast("long").alias("l"), (c("s_suppkey") % 25).cast("long").alias("r"))
    return R.edges_of(t.nation.select(c("n_nationkey").cast("long").alias("n_nationkey")), e, "n_nationkey", "l", "r")


@query("j12_regex_join", "SELECT p_partkey, r_regionkey FROM part JOIN region ON regexp_matches(p_type, '(?i)^' || left(r_name, 1))")
def j12(t: Tables):
    patterns = t.region.select("r_regionkey", F.concat(F.lit("^"), F.substring("r_name", 1, 1)).alias("pattern"))
    return R.regex_join(t.part, "p_type", patterns, "pattern").select("p_partkey", "r_regionkey")


@query("j14_interval_join", "SELECT d, count(event_id) AS n FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS d) LEFT JOIN events ON ts >= d AND ts < d + INTERVAL 1 DAY GROUP BY d")
def j14(t: Tables):
    by_day = t.events.groupBy(F.date_trunc("day", "ts").alias("d")).agg(F.count("*").alias("n"))
    return R.dense_series(by_day, "2024-01-01", "2024-01-30", "day", "d")


@query(
    "j15_dense_hours",
    "SELECT h, coalesce(n, 0)::BIGINT AS n, coalesce(errors, 0)::BIGINT AS errors FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-07', INTERVAL 1 HOUR)) AS h) LEFT JOIN (SELECT date_trunc('hour', ts) AS h2, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1) ON h = h2",
)
def j15(t: Tables):
    by_hour = t.events.groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").alias("n"), F.count_if(c("event_type") == "error").alias("errors"))
    return R.dense_series(by_hour, "2024-01-05", "2024-01-07", "hour", "h")


@query("j16_literal_table", "SELECT event_type, ordinal, coalesce(n, 0)::BIGINT AS n FROM (VALUES ('view', 0), ('click', 1), ('refund', 2)) v(event_type, ordinal) LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) USING (event_type)")
def j16(t: Tables):
    n = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    return R.literal_table(n, ["view", "click", "refund"], "event_type").select("event_type", "ordinal", F.coalesce("n", F.lit(0)).alias("n"))


@query("j17_update_from", "SELECT o_orderkey, coalesce(s, o_orderstatus) AS o_orderstatus FROM orders LEFT JOIN (SELECT l_orderkey, max(CASE WHEN l_linestatus = 'F' THEN 'D' END) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def j17(t: Tables):
    new = t.lineitem.groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.max(F.when(c("l_linestatus") == "F", "D")).alias("o_orderstatus"))
    return R.update_from(t.orders.select("o_orderkey", "o_orderstatus"), new, "o_orderkey", ["o_orderstatus"])


@query("g1_conditional_counts", "SELECT event_type, count(*) AS total, count(*) FILTER (WHERE value > 50) AS high, count(*) FILTER (WHERE user_id % 2 = 0) AS even FROM events GROUP BY 1")
def g1(t: Tables):
    return R.conditional_counts(t.events, ["event_type"], high=c("value") > 50, even=c("user_id") % 2 == 0)


@query(
    "g2_breakdowns",
    """SELECT CASE WHEN grouping(o_orderstatus) = 0 THEN 'status' WHEN grouping(o_orderpriority) = 0 THEN 'priority' ELSE 'year' END AS dimension, coalesce(o_orderstatus, o_orderpriority, y) AS value, count(*) AS n
    FROM (SELECT *, year(o_orderdate)::VARCHAR AS y FROM orders) GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (y))""",
)
def g2(t: Tables):
    return R.breakdowns(t.orders, {"status": c("o_orderstatus"), "priority": c("o_orderpriority"), "year": F.year("o_orderdate")})


@query("g3_distinct_counts", "SELECT count(DISTINCT user_id) AS users, count(DISTINCT concat_ws('|', user_id, event_type)) AS pairs FROM events")
def g3(t: Tables):
    return t.events.agg(F.countDistinct("user_id").alias("users"), R.composite_distinct("user_id", "event_type").alias("pairs"))


@query("g4_distinct_lists", "SELECT user_id, coalesce(array_to_string(list_sort(list(DISTINCT event_type) FILTER (WHERE value > 60)), ','), '') AS types FROM events GROUP BY 1")
def g4(t: Tables):
    return t.events.groupBy("user_id").agg(F.array_join(R.distinct_where("event_type", c("value") > 60), ",").alias("types"))


@query("g5_nested_json", "SELECT l_orderkey, '[' || string_agg('{\"l_linenumber\":' || l_linenumber || ',\"l_partkey\":' || l_partkey || '}', ',' ORDER BY l_linenumber, l_partkey) || ']' AS lines FROM lineitem GROUP BY 1")
def g5(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg(R.nested_list(["l_linenumber", "l_partkey"], ["l_linenumber", "l_partkey"]).alias("lines"))


@query("g6_any", "SELECT user_id, bool_or(event_type = 'error') AS failed, bool_and(value > 1) AS all_over FROM events GROUP BY 1")
def g6(t: Tables):
    return t.events.groupBy("user_id").agg(F.bool_or(c("event_type") == "error").alias("failed"), F.bool_and(c("value") > 1).alias("all_over"))


@query("g7_oldest_waiting", "SELECT o_orderstatus, min(o_orderdate) AS oldest, max(o_orderdate) AS newest, count(*) AS n FROM orders GROUP BY 1")
def g7(t: Tables):
    return t.orders.groupBy("o_orderstatus").agg(F.min("o_orderdate").alias("oldest"), F.max("o_orderdate").alias("newest"), F.count("*").alias("n"))


@query("g8_ratios", "SELECT user_id, round(count(*) FILTER (WHERE event_type = 'purchase')::DOUBLE / nullif(count(*) FILTER (WHERE event_type = 'view'), 0)::DOUBLE, 3) AS rate FROM events GROUP BY 1")
def g8(t: Tables):
    return t.events.groupBy("user_id").agg(R.ratio(F.count_if(c("event_type") == "purchase"), F.count_if(c("event_type") == "view")).alias("rate"))


@query("g9_quality_summary", "SELECT quality, count(*) AS n, round(avg(n_chars), 2) AS chars, count(*) FILTER (WHERE n_chars >= 2000) AS long FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def g9(t: Tables):
    return t.labels.join(t.documents, "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 2).alias("chars"), F.count_if(c("n_chars") >= 2000).alias("long"))


def _duration():
    return F.expr("cast(floor(value * 100) as bigint)")



@query("g10_usage_rollup", "SELECT ts::DATE::VARCHAR AS day, event_type, count(*)::BIGINT AS request_count, sum(floor(value * 100)::BIGINT)::BIGINT AS total_duration FROM events GROUP BY 1, 2")
def g10(t: Tables):
    rows = t.events.withColumn("duration", _duration())
    first, second = rows.where("event_id % 2 = 0"), rows.where("event_id % 2 <> 0")
    rollup = lambda df: R.usage_rollup(df, F.to_date("ts").cast("string"), ["event_type"], "duration")
    return R.merge_rollups(rollup(first), rollup(second), ["event_type"])


@query(
    "g11_nearest_rank",
    "SELECT event_type, len(s)::BIGINT AS n, s[ceil(len(s) * 0.5)::INT] AS p50, s[ceil(len(s) * 0.95)::INT] AS p95, s[len(s)] AS max FROM (SELECT event_type, list_sort(list(value)) AS s FROM events GROUP BY 1)",
)
def g11(t: Tables):
    return R.nearest_rank(t.events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("g12_weighted_average", "SELECT event_type, round(sum(d)::DOUBLE / sum(n)::DOUBLE, 3) AS mean FROM (SELECT ts::DATE AS day, event_type, count(*) AS n, sum(floor(value * 100)::BIGINT) AS d FROM events GROUP BY 1, 2) GROUP BY 1")
def g12(t: Tables):
    rollup = R.usage_rollup(t.events.withColumn("duration", _duration()), F.to_date("ts"), ["event_type"], "duration")
    return rollup.groupBy("event_type").agg(R.ratio(F.sum("total_duration"), F.sum("request_count")).alias("mean"))


@query("g13_contingency", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def g13(t: Tables):
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("g14_group_transitions", "SELECT o_orderstatus, o_orderpriority, sum(1)::BIGINT AS n, max(o_orderdate) AS latest FROM orders GROUP BY 1, 2 ORDER BY latest DESC, 1, 2 LIMIT 6")
def g14(t: Tables):
    rows = t.orders.select("o_orderstatus", "o_orderpriority", F.lit(1).alias("n"), c("o_orderdate").alias("latest"))
    return R.group_transitions(rows, ["o_orderstatus", "o_orderpriority"], "n", "latest", 6)


@query("g15_utilisation", "SELECT user_id, least(100.0, round(sum(floor(value * 100)::BIGINT)::DOUBLE * 100 / nullif(date_diff('second', min(ts), max(ts)) * 2, 0)::DOUBLE, 1)) AS used FROM events GROUP BY 1")
def g15(t: Tables):
    span = F.unix_seconds(F.max("ts").cast("timestamp")) - F.unix_seconds(F.min("ts").cast("timestamp"))
    return t.events.groupBy("user_id").agg(R.utilisation(F.sum(_duration()), span, F.lit(2)).alias("used"))


@query(
    "g16_manifest",
    "SELECT sum(n)::BIGINT AS total, j AS breakdown, sha256(j) AS manifest FROM (SELECT sum(n) AS n, '[' || string_agg('{\"o_orderstatus\":\"' || o_orderstatus || '\",\"o_orderpriority\":\"' || o_orderpriority || '\",\"n\":' || n || '}', ',' ORDER BY o_orderstatus, o_orderpriority) || ']' AS j FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)) GROUP BY j",
)
def g16(t: Tables):
    return R.breakdown_manifest(t.orders, ["o_orderstatus", "o_orderpriority"])


@query("w1_fair_merge", "SELECT o_orderkey, o_orderstatus, class_rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS class_rank FROM orders) ORDER BY class_rank, o_orderstatus LIMIT 50")
def w1(t: Tables):
    return R.fair_merge(t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate"), "o_orderstatus", [c("o_orderdate"), c("o_orderkey")], 50).select("o_orderkey", "o_orderstatus", "class_rank")


@query("w2_page_total", "SELECT event_id, count(*) OVER () AS total FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 25 OFFSET 25")
def w2(t: Tables):
    return R.with_total(t.events.where("event_type = 'error'"), [F.desc("ts"), c("event_id")], 25, 25).select("event_id", "total")


@query("w3_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderdate DESC, o_orderkey")
def w3(t: Tables):
    return R.best_per_key(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.desc("o_orderdate"), c("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("w4_first_per_key", "SELECT DISTINCT ON (p_brand, p_size) p_partkey, p_brand, p_size FROM part ORDER BY p_brand, p_size, p_retailprice DESC, p_partkey")
def w4(t: Tables):
    return R.best_per_key(t.part, ["p_brand", "p_size"], [F.desc("p_retailprice"), c("p_partkey")]).select("p_partkey", "p_brand", "p_size")


@query("w5_last_write", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def w5(t: Tables):
    return R.last_write(t.events.select("user_id", "event_id", "event_type"), "user_id", "event_id")


_LEVELS = ["purchase", "signup", "click"]


@query(
    "w6_current_validation",
    "SELECT DISTINCT ON (user_id) user_id, event_type, event_id FROM events WHERE event_type IN ('purchase', 'signup', 'click') AND value > 5 AND ts + INTERVAL 20 DAY > TIMESTAMP '2024-02-01' ORDER BY user_id, list_position(['purchase', 'signup', 'click'], event_type), ts DESC, event_id",
)
def w6(t: Tables):
    valid = t.events.where(c("event_type").isin(_LEVELS) & (c("value") > 5) & (c("ts") + F.expr("interval 20 days") > F.lit("2024-02-01").cast("timestamp")))
    return R.best_per_key(valid, ["user_id"], [R.ordinal("event_type", _LEVELS), F.desc("ts"), c("event_id")]).select("user_id", "event_type", "event_id")


@query(
    "w7_next_numbers",
    "WITH o AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, o_orderstatus = 'O' AS fresh FROM (SELECT * FROM orders WHERE o_orderstatus <> 'P')), b AS (SELECT o_custkey, count(*) FILTER (WHERE NOT fresh) AS m FROM o GROUP BY 1) SELECT o_orderkey, o_custkey, (m + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INT AS number FROM o JOIN b USING (o_custkey) WHERE fresh",
)
def w7(t: Tables):
    old = t.orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").cast("int").alias("number"))
    new = t.orders.where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey")
    return R.next_numbers(new, old, "o_custkey", "number", ["o_orderkey"])


@query("w8_relative_cut", "SELECT event_id FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS top FROM events) WHERE value >= greatest(top * 0.5, 0.01)")
def w8(t: Tables):
    return R.relative_cut(t.events, "user_id", "value").select("event_id")


@query("w9_nulls_order", "SELECT event_id FROM (SELECT event_id, nullif(event_type, 'view') AS e, nullif(user_id % 5, 0) AS u FROM events) ORDER BY e ASC NULLS FIRST, u DESC NULLS LAST, event_id LIMIT 40")
def w9(t: Tables):
    rows = t.events.select("event_id", F.nullif("event_type", F.lit("view")).alias("e"), F.nullif(c("user_id") % 5, F.lit(0)).alias("u"))
    return R.top_with_nulls(rows, [F.asc_nulls_first("e"), F.desc_nulls_last("u"), c("event_id")], 40).select("event_id")


@query("w10_page", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30 OFFSET 90")
def w10(t: Tables):
    return R.page(t.orders, [F.desc("o_orderdate"), F.desc("o_orderkey")], 90, 30).select("o_orderkey")


@query(
    "w11_budget_prefix",
    "SELECT doc_id FROM (SELECT doc_id, row_number() OVER w AS r, sum(octet_length(encode(text))) OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)) WHERE r = 1 OR (s <= 20000 AND r <= 16)",
)
def w11(t: Tables):
    rows = t.documents.select("doc_id", "source", F.octet_length("text").alias("bytes"))
    return R.budget_prefix(rows, "source", ["doc_id"], "bytes", 20000, 16).select("doc_id")


@query("w12_carry_forward", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events")
def w12(t: Tables):
    rows = t.events.withColumn("h", F.when(c("event_type") == "signup", c("event_id")))
    return rows.select("event_id", R.carried_forward("h", "user_id", ["ts", "event_id"]).alias("section"))


@query(
    "w13_failure_streaks",
    "SELECT event_type AS owner, 'odd' AS code, count(*) AS failures FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS r FROM events WHERE ts <= TIMESTAMP '2024-01-20' AND ts > TIMESTAMP '2024-01-20' - INTERVAL 600 MINUTE) WHERE r <= 2 GROUP BY 1 HAVING count(*) FILTER (WHERE event_id % 2 = 1) = 2",
)
def w13(t: Tables):
    rows = t.events.select(c("event_type").alias("owner"), "ts", "event_id", F.when(c("event_id") % 2 == 1, "odd").otherwise("even").alias("code"))
    return R.failure_streaks(rows, "owner", "ts", c("event_id") % 2 == 1, "code", F.lit("2024-01-20").cast("timestamp"), 2, 600)


@query("u1_stage_counts", "SELECT 'orders' AS stage, count(*) FILTER (WHERE o_orderstatus = 'O') AS n FROM orders UNION ALL SELECT 'lines', count(*) FILTER (WHERE l_linestatus = 'O') FROM lineitem UNION ALL SELECT 'errors', count(*) FILTER (WHERE event_type = 'error') FROM events")
def u1(t: Tables):
    return R.stage_counts({"orders": (t.orders, c("o_orderstatus") == "O"), "lines": (t.lineitem, c("l_linestatus") == "O"), "errors": (t.events, c("event_type") == "error")})


@query("u2_latest_of_histories", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def u2(t: Tables):
    return R.latest_of_histories([t.orders.where("o_orderstatus = 'O'"), t.orders.where("o_orderstatus = 'F'")], "o_custkey", "o_orderkey")


@query("u3_aligned_union", "SELECT s_suppkey AS key, s_name AS name, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def u3(t: Tables):
    return R.aligned_union(t.supplier.select(c("s_suppkey").alias("key"), c("s_name").alias("name")), t.customer.select(c("c_custkey").alias("key"), c("c_name").alias("name"), c("c_mktsegment").alias("segment")))


_TREE_SQL = "WITH RECURSIVE e AS (SELECT s_suppkey AS child, CASE WHEN s_suppkey > 1 THEN s_suppkey // 2 END AS parent FROM supplier), r AS (SELECT child AS root, child AS node, 0 AS depth FROM e UNION ALL SELECT r.root, e.parent, r.depth + 1 FROM r JOIN e ON e.child = r.node WHERE e.parent IS NOT NULL) "


def _tree(t: Tables):
    k = c("s_suppkey")
    e = t.supplier.select(k.alias("child"), F.when(k > 1, F.floor(k / 2)).alias("parent"))
    return R.closure(t.spark, e, e.select("child"), "child", "parent")


@query("u4_closure", _TREE_SQL + "SELECT DISTINCT root, node FROM r")
def u4(t: Tables):
    return _tree(t).select("root", "node")


@query("u5_ancestry_depth", _TREE_SQL + "SELECT root, node, min(depth)::INT AS depth FROM r GROUP BY 1, 2")
def u5(t: Tables):
    return _tree(t)


@query("u6_ordered_union", "SELECT key, source, min(ordinal) AS ordinal FROM (SELECT key, source, ordinal, min(source) OVER (PARTITION BY key) AS s FROM (SELECT c_nationkey AS key, 0 AS source, c_custkey AS ordinal FROM customer WHERE c_nationkey < 12 UNION ALL SELECT s_nationkey, 1, s_suppkey FROM supplier)) WHERE source = s GROUP BY 1, 2")
def u6(t: Tables):
    first = t.customer.where("c_nationkey < 12").select(c("c_nationkey").alias("key"), c("c_custkey").alias("ordinal"))
    return R.ordered_union(first, t.supplier.select(c("s_nationkey").alias("key"), c("s_suppkey").alias("ordinal")), "key")
