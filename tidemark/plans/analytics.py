"""Inventory A over ``events`` (type as outcome, value as duration), ``orders`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from .registry import Tables, query

c = F.col


def _at(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query("a1_public_stats", "SELECT (SELECT count(*) FROM events) AS requests, (SELECT count(*) FROM events WHERE event_type = 'view') AS answered, (SELECT round(count(*) FILTER (WHERE user_id % 4 = 0)::DOUBLE / count(*), 3) FROM events) AS no_model_rate, (SELECT count(DISTINCT p_brand) FROM part) AS vendors, (SELECT count(DISTINCT (p_brand, p_size)) FROM part) AS platforms, (SELECT max_by(o_custkey, o_orderkey) FROM orders) AS passed, (SELECT max(o_orderkey) FROM orders) AS total")
def a1(t: Tables):
    log = t.events.withColumn("outcome", F.when(c("event_type") == "view", "success").otherwise(c("event_type")))
    cover = t.part.select(c("p_brand").alias("vendor"), c("p_size").alias("platform"))
    evals = t.orders.select(c("o_custkey").alias("passed"), c("o_orderkey").alias("total"), c("o_orderkey").alias("at"))
    return A.public_stats(log, cover, evals, "outcome", c("user_id") % 4)


@query("a2_growth_series", "SELECT bucket, coalesce(a, 0)::BIGINT AS requests, coalesce(u, 0)::BIGINT AS users, coalesce(e, 0)::BIGINT AS errors FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS bucket) LEFT JOIN (SELECT date_trunc('day', ts) AS d, count(*) AS a, count(DISTINCT user_id) AS u, count(*) FILTER (WHERE event_type = 'error') AS e FROM events GROUP BY 1) ON d = bucket")
def a2(t: Tables):
    e = t.events
    return A.daily_series({"requests": (e, "ts", F.count("*")), "users": (e, "ts", F.countDistinct("user_id")), "errors": (e, "ts", F.count_if(c("event_type") == "error"))}, "2024-01-01", "2024-01-30")


@query("a3_request_analytics", "SELECT bucket, coalesce(t, 0)::BIGINT AS total, coalesce(v, 0)::BIGINT AS view, coalesce(e, 0)::BIGINT AS error FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-11', INTERVAL 1 HOUR)) AS bucket) LEFT JOIN (SELECT date_trunc('hour', ts) AS h, count(*) AS t, count(*) FILTER (WHERE event_type = 'view') AS v, count(*) FILTER (WHERE event_type = 'error') AS e FROM events GROUP BY 1) ON h = bucket")
def a3(t: Tables):
    return A.request_analytics(t.events, "ts", "event_type", ["view", "error"], "2024-01-10", "2024-01-11")


@query("a4_activity", "SELECT bucket, coalesce(n, 0)::BIGINT AS published, coalesce(m, 0)::BIGINT AS shipped FROM (SELECT unnest(generate_series(TIMESTAMP '1995-06-01', TIMESTAMP '1995-06-30', INTERVAL 1 DAY)) AS bucket) LEFT JOIN (SELECT date_trunc('day', o_orderdate) AS d, count(*) AS n FROM orders GROUP BY 1) ON d = bucket LEFT JOIN (SELECT date_trunc('day', l_shipdate) AS s, count(*) AS m FROM lineitem GROUP BY 1) ON s = bucket")
def a4(t: Tables):
    return A.daily_series({"published": (t.orders, "o_orderdate", F.count("*")), "shipped": (t.lineitem, "l_shipdate", F.count("*"))}, "1995-06-01", "1995-06-30")


@query("a5_hourly_published", "SELECT bucket, coalesce(n, 0)::BIGINT AS published FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-03', INTERVAL 1 HOUR)) AS bucket) LEFT JOIN (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) ON h = bucket")
def a5(t: Tables):
    return A.daily_series({"published": (t.events.where("event_type = 'purchase'"), "ts", F.count("*"))}, "2024-01-02", "2024-01-03", "hour")


@query("a6_overview", "SELECT *, round(errors::DOUBLE / nullif(requests, 0), 3) AS error_rate, round(purchases::DOUBLE / nullif(views, 0), 3) AS resolution FROM (SELECT count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-25') AS recent, count(DISTINCT user_id) AS users FROM events)")
def a6(t: Tables):
    kind = lambda k: F.count_if(c("event_type") == k)
    counters = {"requests": F.count("*"), "errors": kind("error"), "purchases": kind("purchase"), "views": kind("view"), "recent": F.count_if(c("ts") >= _at("2024-01-25")), "users": F.countDistinct("user_id")}
    return A.overview(t.events, counters, {"error_rate": ("errors", "requests"), "resolution": ("purchases", "views")})


_STAGES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "9-NONE"]


def _funnel(t: Tables):
    status = F.when(c("o_orderstatus") == "O", "queued").when(c("o_orderstatus") == "P", "running").when(c("o_custkey") % 9 == 0, "failed").otherwise("completed")
    rows = t.orders.withColumn("status", status).withColumn("owner", (c("o_custkey") % 4).cast("string"))
    return A.funnel(rows, _STAGES, "o_orderpriority", "status", "o_orderdate", "owner", c("status") == "running")


@query(
    "a7_stage_funnel",
    "SELECT (i - 1)::INT AS ordinal, stage, count(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS waiting, count(o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS running, count(o_orderkey) FILTER (WHERE o_orderstatus = 'F' AND o_custkey % 9 <> 0) AS completed, count(o_orderkey) FILTER (WHERE o_orderstatus = 'F' AND o_custkey % 9 = 0) AS failed, min(o_orderdate) FILTER (WHERE o_orderstatus = 'O') AS oldest_waiting_at, coalesce(string_agg(DISTINCT (o_custkey % 4)::VARCHAR, ',' ORDER BY (o_custkey % 4)::VARCHAR) FILTER (WHERE o_orderstatus = 'P'), '') AS owners FROM (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '9-NONE']) AS stage, unnest([1, 2, 3, 4, 5]) AS i) LEFT JOIN orders ON o_orderpriority = stage GROUP BY 1, 2",
)
def a7(t: Tables):
    return _funnel(t).withColumn("owners", F.array_join("owners", ","))


@query("a8_liveness", "SELECT c_custkey::VARCHAR AS owner, CASE WHEN c_custkey % 10 = 0 THEN 'paused' WHEN h IS NULL THEN 'standby' WHEN h < TIMESTAMP '2024-01-20' - INTERVAL 14400 MINUTE THEN 'stale' ELSE 'running' END AS state FROM customer LEFT JOIN (SELECT user_id, max(ts) AS h FROM events WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY 1) ON user_id = c_custkey")
def a8(t: Tables):
    workers = t.customer.select(c("c_custkey").cast("string").alias("owner"), (c("c_custkey") % 10 == 0).alias("paused"))
    beats = t.events.where(c("ts") <= _at("2024-01-20")).select(c("user_id").cast("string").alias("owner"), c("ts").alias("at"))
    return A.liveness(workers, beats, _at("2024-01-20"), 14400).select("owner", "state")


@query("a9_source_intake", "SELECT l_returnflag AS stage, count(*) AS n, min(l_shipdate) AS oldest FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1 UNION ALL SELECT 'R' AS stage, 0, NULL WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'R') UNION ALL SELECT 'A', 0, NULL WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'A')")
def a9(t: Tables):
    rows = t.lineitem.where("l_linestatus = 'O'").select("l_returnflag", F.lit("queued").alias("status"), "l_shipdate", F.lit("x").alias("owner"))
    out = A.funnel(rows, ["N", "R", "A"], "l_returnflag", "status", "l_shipdate", "owner", F.lit(False))
    return out.select("stage", c("waiting").alias("n"), c("oldest_waiting_at").alias("oldest"))


@query("a10_record_pipeline", "SELECT l_shipmode AS stage, n FROM (SELECT l_returnflag AS l_shipmode, count(*) FILTER (WHERE l_quantity < 25) AS n FROM lineitem GROUP BY 1)")
def a10(t: Tables):
    rows = t.lineitem.select("l_returnflag", F.when(c("l_quantity") < 25, "running").otherwise("completed").alias("status"), "l_shipdate", F.lit("x").alias("owner"))
    return A.funnel(rows, ["N", "R", "A"], "l_returnflag", "status", "l_shipdate", "owner", F.lit(False)).select("stage", c("running").alias("n"))


@query("a11_coverage_list", "SELECT c_custkey, count(o_orderkey) AS parts FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def a11(t: Tables):
    return A.with_progress(t.customer.select("c_custkey"), t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", F.lit(True)).select("c_custkey", "parts")


@query("a12_source_list", "SELECT o_orderkey, n AS parts, d AS done, round(d * 100.0 / n, 1)::DOUBLE AS percent FROM orders JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'F') AS d FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def a12(t: Tables):
    parts = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    return A.with_progress(t.orders.select("o_orderkey"), parts, "o_orderkey", c("l_linestatus") == "F").where("parts > 0")


@query("a13_active_sources", "SELECT o_orderkey, count(*) AS parts, count(*) FILTER (WHERE l_linestatus = 'F') AS done FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY 1")
def a13(t: Tables):
    parts = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    return A.with_progress(t.orders.where("o_orderstatus = 'P'").select("o_orderkey"), parts, "o_orderkey", c("l_linestatus") == "F").where("parts > 0").drop("percent")


@query("a14_review_exceptions", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY CASE WHEN o_totalprice > 200000 THEN 0 ELSE 1 END, o_orderkey LIMIT 50")
def a14(t: Tables):
    return A.exceptions(t.orders.where("o_orderstatus = 'P'"), "o_orderkey", F.when(c("o_totalprice") > 200000, 0).otherwise(1), 50).select("o_orderkey")


@query("a15_run_costs", "SELECT l_orderkey, sum(l_quantity::BIGINT)::BIGINT AS tokens, sum((l_returnflag = 'R')::BIGINT)::BIGINT AS published, round(sum(l_quantity::BIGINT)::DOUBLE / nullif(sum((l_returnflag = 'R')::BIGINT), 0)::DOUBLE, 2) AS tokens_per_revision FROM lineitem GROUP BY 1")
def a15(t: Tables):
    return A.run_costs(t.lineitem, "l_orderkey", c("l_quantity").cast("long"), (c("l_returnflag") == "R").cast("long"))


@query("a16_quality_dashboard", "SELECT lang, count(*) AS n, round(avg(n_chars), 2) AS mean, count(*) FILTER (WHERE n_chars >= 1000) AS usable, count(*) FILTER (WHERE n_chars >= 5000) AS long FROM documents GROUP BY 1")
def a16(t: Tables):
    return A.quality_dashboard(t.documents, "lang", "n_chars", {"usable": 1000, "long": 5000})


@query("a17_validation_list", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R' ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100")
def a17(t: Tables):
    rows = t.lineitem.where("l_returnflag = 'R'")
    return rows.orderBy(F.desc("l_shipdate"), "l_orderkey", "l_linenumber", "l_partkey").limit(100).select("l_orderkey", "l_linenumber", "l_partkey")


@query("a18_task_list", "SELECT o_orderkey, l_shipdate, l_returnflag FROM orders LEFT JOIN (SELECT DISTINCT ON (l_orderkey) l_orderkey, l_shipdate, l_returnflag FROM lineitem ORDER BY l_orderkey, l_shipdate DESC, l_returnflag DESC) ON l_orderkey = o_orderkey")
def a18(t: Tables):
    events = t.lineitem.select(c("l_orderkey").alias("o_orderkey"), "l_shipdate", "l_returnflag")
    return A.latest_event(t.orders.select("o_orderkey"), events, "o_orderkey", ["l_shipdate", "l_returnflag"], ["l_shipdate", "l_returnflag"])


@query("a19_request_detail", "SELECT event_id, c_name, o_orderkey FROM events LEFT JOIN customer ON c_custkey = user_id LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON o_custkey = user_id")
def a19(t: Tables):
    from ..operators.relational import star

    last = t.orders.select(c("o_custkey").alias("user_id"), "o_orderkey")
    out = A.latest_event(t.events.select("event_id", "user_id"), last, "user_id", ["o_orderkey"], ["o_orderkey"])
    return star(out, [(t.customer, "user_id", "c_custkey")], "left").select("event_id", "c_name", "o_orderkey")


@query("a20_pipeline_listing", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 300")
def a20(t: Tables):
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(300).select("event_id")


@query(
    "a21_evaluation",
    "SELECT event_type AS type, count(*) FILTER (WHERE user_id % 5 > 0) AS passed, count(*) FILTER (WHERE user_id % 5 = 0) AS failed, count(*) FILTER (WHERE user_id % 5 = 0 AND user_id % 2 = 0) AS false_safe, s[ceil(n * 0.5)::INT] AS p50, s[ceil(n * 0.95)::INT] AS p95, s[n] AS max FROM events JOIN (SELECT event_type AS e, list_sort(list(value)) AS s, count(*)::INT AS n FROM events GROUP BY 1) ON e = event_type GROUP BY event_type, s, n",
)
def a21(t: Tables):
    cases = t.events.select(c("event_id").alias("case_id"), c("event_type").alias("type"), F.lit("ok").alias("expected"), "user_id")
    results = t.events.select(c("event_id").alias("case_id"), F.when(c("user_id") % 5 > 0, "ok").otherwise("no").alias("got"), c("value").alias("latency"))
    return A.evaluation(cases, results, c("user_id") % 2 == 0)


@query("a22_token_totals", "SELECT sum(l_quantity::BIGINT)::BIGINT AS total, (sum(l_quantity::BIGINT) FILTER (WHERE l_shipdate >= TIMESTAMP '1997-01-01'))::BIGINT AS today FROM lineitem")
def a22(t: Tables):
    q = c("l_quantity").cast("long")
    return A.overview(t.lineitem, {"total": F.sum(q), "today": F.sum(F.when(c("l_shipdate") >= F.lit("1997-01-01").cast("timestamp"), q))}, {})


@query("a23_orphaned_runs", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' - INTERVAL 15 MINUTE AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N')")
def a23(t: Tables):
    live = t.lineitem.where("l_returnflag = 'N'").select(c("l_orderkey").alias("o_orderkey"))
    return A.orphaned(t.orders, live, "o_orderkey", "o_orderdate", F.lit("1997-01-01").cast("timestamp_ntz")).select("o_orderkey")


@query("a24_work_load", "SELECT CASE WHEN event_type IN ('click', 'view') THEN 'light' ELSE event_type END AS class, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1")
def a24(t: Tables):
    e = c("event_type")
    circuits = t.events.where("event_type = 'error'").select(c("event_type").alias("class")).distinct()
    return A.load_by_class(t.events, circuits, F.when(e.isin("click", "view"), "light").otherwise(e))


@query("a25_due_targets", "SELECT o_orderkey AS target_id FROM orders WHERE o_custkey % 7 <> 0 AND (o_orderstatus = 'P' OR o_orderdate <= TIMESTAMP '1993-01-01') ORDER BY o_custkey % 11 DESC, o_orderdate, o_orderkey LIMIT 80")
def a25(t: Tables):
    k = c("o_custkey")
    rows = t.orders.select(c("o_orderkey").alias("target_id"), (k % 7 == 0).alias("paused"), F.when(c("o_orderstatus") == "P", "queued").otherwise("done").alias("status"), c("o_orderdate").alias("next_check_at"), (k % 11).alias("priority"), c("o_orderdate").alias("created_at"))
    return A.due(rows, F.lit("1993-01-01").cast("timestamp_ntz"), 80).select("target_id")


@query("a26_coverage_page", "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20")
def a26(t: Tables):
    return A.coverage_page(t.customer, "c_acctbal", c("c_nationkey") > 10, "c_custkey")[1].select("c_custkey")


@query("a26_coverage_summary", "SELECT round(avg(c_acctbal), 2) AS average, count(*) FILTER (WHERE c_nationkey > 10) AS due FROM customer")
def a26b(t: Tables):
    return A.coverage_page(t.customer, "c_acctbal", c("c_nationkey") > 10, "c_custkey")[0]


@query("a27_bottlenecks", "SELECT DISTINCT ON (flow) flow, o_orderpriority AS stage FROM (SELECT CASE WHEN o_orderpriority < '3' THEN 'fast' ELSE 'slow' END AS flow, o_orderpriority, min(o_orderdate) AS oldest FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2) ORDER BY flow, oldest, o_orderpriority")
def a27(t: Tables):
    rows = t.orders.where("o_orderstatus = 'O'").groupBy(c("o_orderpriority").alias("stage")).agg(F.min("o_orderdate").alias("oldest_waiting_at"))
    return A.bottlenecks(rows.withColumn("flow", F.when(c("stage") < "3", "fast").otherwise("slow")), "flow").select("flow", "stage")


@query("a28_run_averages", "SELECT count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS tokens, round(sum(l_quantity::BIGINT)::DOUBLE / count(*), 3) AS mean FROM lineitem")
def a28(t: Tables):
    return A.overview(t.lineitem, {"n": F.count("*"), "tokens": F.sum(c("l_quantity").cast("long"))}, {"mean": ("tokens", "n")})
