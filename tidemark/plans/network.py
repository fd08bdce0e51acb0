"""Inventory N5, N9 to N17, V10 to V15, J13, over texts that Spark derives from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import network as N
from ..sources.files import shared_path
from .documents import _TRI
from .registry import Tables, query

c = F.col


def _changes(t: Tables):
    """A change a user: a command for each event."""
    e, k = c("event_type"), (c("user_id") % 90).cast("string")
    line = F.when(e == "error", F.concat(F.lit("no shutdown "), k)).when(e == "signup", F.concat(F.lit("ntp server 10.0.0."), k)).when(e == "purchase", "reload").when(e == "click", F.concat(F.lit("show vlan "), k)).otherwise(F.concat(F.lit("frobnicate "), k))
    rare = t.events.where((c("event_type") != "view") | (c("value") > 40)).where((c("event_type") != "purchase") | (c("value") > 60))
    return rare.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_set(line.alias("line"))).alias("commands")).withColumn("change_id", F.concat_ws("/", c("user_id").cast("string"), c("day").cast("string")))


_EV = "(SELECT user_id || '/' || ts::DATE AS change_id, event_type AS e FROM events WHERE (event_type <> 'view' OR value > 40) AND (event_type <> 'purchase' OR value > 60))"


@query("n9_change_review", f"SELECT change_id, CASE WHEN bool_or(e IN ('error', 'purchase', 'view')) THEN 'high' WHEN bool_or(e = 'signup') THEN 'medium' ELSE 'low' END AS risk, (max((e = 'error')::INT) + max((e = 'signup')::INT) + max((e = 'purchase')::INT) + max((e = 'click')::INT))::INT AS n_rules, max((e = 'view')::INT)::BIGINT AS unknown_lines FROM {_EV} GROUP BY 1")
def n9(t: Tables):
    return N.change_review(_changes(t), "change_id").select("change_id", "risk", F.size("rules").alias("n_rules"), "unknown_lines")


@query("n10_guidance", f"SELECT change_id, greatest(max((e = 'purchase')::INT) + max((e = 'view')::INT), 1)::INT AS n, max((e = 'view')::INT) = 1 AS unknown FROM {_EV} GROUP BY 1")
def n10(t: Tables):
    return N.change_review(_changes(t), "change_id").select("change_id", F.size("guidance").alias("n"), F.array_contains("guidance", N.UNKNOWN_GUIDANCE).alias("unknown"))


# the text after a change by the user: unchanged, changed, with an interface state, with a critical error, empty
_AFTER = ["state one", "state two", "state two\nGi1/0/1 up  up", "state two\n%SYS-2-MALLOCFAIL", ""]


@query(
    "n11_change_verification",
    f"""SELECT change_id, CASE WHEN u = 3 THEN 'failed' WHEN NOT writes THEN 'passed' WHEN u = 0 THEN 'failed' WHEN u = 4 OR (u = 1 AND error) THEN 'partial' ELSE 'passed' END AS result
    FROM (SELECT change_id, split_part(change_id, '/', 1)::INT % 5 AS u, bool_or(e NOT IN ('click', 'view')) AS writes, bool_or(e = 'error') AS error FROM {_EV} GROUP BY 1 HAVING bool_or(e <> 'view'))""",
)
def n11(t: Tables):
    reviewed = N.change_review(_changes(t), "change_id").where("size(rules) > 0")
    user = F.get(F.split("change_id", "/"), F.lit(0)).cast("int")
    texts = reviewed.withColumn("before", F.lit("state one")).withColumn("after", F.get(F.array(*map(F.lit, _AFTER)), user % 5))
    return N.change_verification(texts, "rules", "before", "after").select("change_id", "result")


@query("n5_fingerprint", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Cisco' WHEN 1 THEN 'Juniper' END AS vendor, CASE p_partkey % 3 WHEN 0 THEN 'C9300-' || p_size WHEN 1 THEN 'EX' || p_size END AS model, CASE p_partkey % 3 WHEN 0 THEN '17.' || p_size || '.1' WHEN 1 THEN '21.' || p_size END AS version FROM part")
def n5(t: Tables):
    k, s = c("p_partkey") % 3, c("p_size").cast("string")
    text = F.when(k == 0, F.concat(F.lit("Cisco IOS XE Software, Version 17."), s, F.lit(".1\nModel number : C9300-"), s, F.lit("\n"))).when(k == 1, F.concat(F.lit("Model: EX"), s, F.lit("\nJunos: 21."), s)).otherwise("nothing")
    f = N.fingerprint(text)
    return t.part.select("p_partkey", f["vendor"].alias("vendor"), f["model"].alias("model"), f["version"].alias("version"))


def _neighbours(t: Tables):
    """A device a supplier, with a block or a line of a table for the supplier of half its number and for itself; some without. Every
    second table has a header that only the type asked for makes a table; it counts as a line."""
    k = c("s_suppkey").cast("long")
    block = lambda n: F.concat(F.lit("Device ID: sw"), n.cast("string"), F.lit("\nPlatform: WS-"), (n % 4).cast("string"), F.lit(",  Capabilities: Switch\nInterface: Gi1/"), n.cast("string"), F.lit(",  Port ID (outgoing port): Gi0/1\n"))
    line = lambda n: F.concat(F.lit("sw"), n.cast("string"), F.lit("    Gi1/"), n.cast("string"), F.lit("   150   R S   WS-C3750  Gi0/1\n"))
    head = F.when(k % 2 == 0, "Device ID    Local Intrfce   Holdtme   Capability  Platform  Port ID\n").otherwise("Neighbor ID   Local   Port\n")
    table = F.concat(head, line(F.floor(k / 2)), line(k))
    text = F.when(k % 3 == 0, table).when(k % 17 == 4, "nothing").otherwise(F.concat(block(F.floor(k / 2)), block(k)))
    return t.supplier.select(F.concat(F.lit("sw"), k.cast("string")).alias("device_hint"), text.alias("content"), F.when((k % 3 == 0) & (k % 2 == 1), "cdp").otherwise("auto").alias("kind"))


_EDGES = """(SELECT 'sw' || s_suppkey AS source, 'sw' || s_suppkey // 2 AS target, 'Gi1/' || s_suppkey // 2 AS local_interface, CASE WHEN s_suppkey % 3 <> 0 THEN 'WS-' || (s_suppkey // 2) % 4 END AS platform FROM supplier WHERE s_suppkey // 2 <> s_suppkey AND (s_suppkey % 3 = 0 OR s_suppkey % 17 <> 4)
  UNION ALL SELECT 'sw' || s_suppkey, 'Neighbor ID', 'Local', NULL FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 2 = 1)"""


@query("n12_neighbour_edges", f"SELECT * FROM {_EDGES}")
def n12(t: Tables):
    return N.neighbour_edges(_neighbours(t), kind="kind").select("source", "target", "local_interface", "platform")


def _routes(t: Tables):
    """A route a part: by a next hop, directly connected, or neither."""
    s, k = c("p_size").cast("string"), c("p_partkey") % 3
    via = F.when(k == 0, F.concat(F.lit("\n  * 10.0.0."), s, F.lit(", from 10.9.9.9, via 10.0.0."), s)).when(k == 1, F.concat(F.lit("\n  directly connected, Gi0/"), s)).otherwise("\n  Known via bgp 1")
    return t.part.select(F.concat(F.lit("r"), c("p_partkey").cast("string")).alias("device_hint"), F.concat(F.lit("Routing entry for 10."), s, F.lit(".0.0/16"), via).alias("content"))


@query(
    "n13_route_edges",
    """SELECT DISTINCT * FROM (SELECT 'r' || p_partkey AS source, CASE WHEN p_partkey % 3 = 0 THEN '10.0.0.' || p_size ELSE '10.' || p_size || '.0.0/16' END AS target, CASE WHEN p_partkey % 3 = 1 THEN 'Gi0/' || p_size END AS local_interface FROM part WHERE p_partkey % 3 <> 2
    UNION ALL SELECT '10.0.0.' || p_size, '10.' || p_size || '.0.0/16', NULL FROM part WHERE p_partkey % 3 = 0)""",
)
def n13(t: Tables):
    return N.route_edges(_routes(t)).select("source", "target", "local_interface")


def _traces(t: Tables):
    """A trace an order: a hop a line of the order, the returned ones silent."""
    hop = F.when(c("l_returnflag") == "R", F.concat(c("l_linenumber").cast("string"), F.lit("  *  *  *"))).otherwise(F.concat(c("l_linenumber").cast("string"), F.lit("  hop"), c("l_suppkey").cast("string"), F.lit(" 1 ms")))
    # repeated line numbers of the data are one hop
    rows = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_suppkey", "l_returnflag")).alias("m")).select("l_orderkey", "l_linenumber", "m.l_suppkey", "m.l_returnflag")
    return rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", hop.alias("h")))), lambda x: x["h"]), "\n").alias("content")).withColumn("device_hint", F.lit("src"))


_HOPS = "(SELECT l_orderkey, l_linenumber, m.s AS s, m.f AS f FROM (SELECT l_orderkey, l_linenumber, min({'s': l_suppkey, 'f': l_returnflag}) AS m FROM lineitem GROUP BY 1, 2))"


@query("n14_trace_hops", f"SELECT l_orderkey, (row_number() OVER w - 1)::INT AS place, coalesce(lag(g) OVER w, 'src') AS source, g AS target FROM (SELECT l_orderkey, l_linenumber, CASE WHEN f = 'R' THEN 'Unanswered hop ' || l_linenumber ELSE 'hop' || s END AS g FROM {_HOPS}) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)")
def n14(t: Tables):
    return N.trace_hops(_traces(t), "l_orderkey").select("l_orderkey", "place", "source", "target")


@query("n15_graph_merge", f"SELECT 'node-' || left(sha256(lower(label)), 16) AS id, label, max(platform) AS platform FROM (SELECT source AS label, NULL AS platform FROM {_EDGES} UNION ALL SELECT target, platform FROM {_EDGES}) GROUP BY label")
def n15(t: Tables):
    return N.merged_graph(N.neighbour_edges(_neighbours(t), kind="kind"))[0].select("id", "label", "platform")


@query("n16_path_status", f"SELECT l_orderkey, count(*) AS hops, bool_and(f <> 'R') AND (l_orderkey % 3 <> 0 OR CASE WHEN l_orderkey % 2 = 0 THEN 'hop' || max(s) ELSE 'hop0' END = arg_max(CASE WHEN f = 'R' THEN 'Unanswered hop ' || l_linenumber ELSE 'hop' || s END, l_linenumber)) AS complete FROM {_HOPS} GROUP BY l_orderkey")
def n16(t: Tables):
    """Every third trace asks for a destination: the largest supplier of the order, or one that no trace reaches."""
    largest = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_suppkey", "l_returnflag")).alias("m")).groupBy("l_orderkey").agg(F.max("m.l_suppkey").alias("s"))
    wanted = largest.where("l_orderkey % 3 = 0").select("l_orderkey", F.when(c("l_orderkey") % 2 == 0, F.concat(F.lit("HOP"), c("s").cast("string"), F.lit(".local"))).otherwise("hop0").alias("destination"))
    return N.path_status(N.trace_hops(_traces(t), "l_orderkey"), "l_orderkey", wanted).select("l_orderkey", "hops", "complete")


@query(
    "n16_parse_diagnostics",
    """SELECT 'sw' || s_suppkey AS device_hint, detected_type, n AS records_parsed, CASE WHEN n = 0 THEN 'unparsed' ELSE 'partial' END AS status, (detected_type IS NOT NULL)::INT AS warnings
    FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey % 17 = 4 THEN NULL ELSE 'cdp' END AS detected_type, CASE WHEN s_suppkey = 0 THEN 0 WHEN s_suppkey % 3 = 0 THEN 1 + s_suppkey % 2 WHEN s_suppkey % 17 = 4 THEN 0 ELSE 1 END::INT AS n FROM supplier)
    UNION ALL SELECT 'r' || p_partkey, 'route', CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END, CASE WHEN p_partkey % 3 = 2 THEN 'unparsed' ELSE 'parsed' END, 0 FROM part
    UNION ALL SELECT 'o' || l_orderkey, 'traceroute', count(DISTINCT l_linenumber)::INT, 'parsed', 0 FROM lineitem GROUP BY l_orderkey""",
)
def n16_diagnostics(t: Tables):
    """Discovery of suppliers, routes of parts, traces of orders."""
    traces = _traces(t).select(F.concat(F.lit("o"), c("l_orderkey").cast("string")).alias("device_hint"), "content", F.lit("traceroute").alias("kind"))
    rows = _neighbours(t).unionByName(_routes(t).withColumn("kind", F.lit(None).cast("string"))).unionByName(traces)
    return N.parse_diagnostics(rows, "device_hint", kind="kind").withColumn("warnings", F.size("warnings"))


@query("n17_upgrade_advice", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_size IN (9, 12) THEN 'supported_with_checks' ELSE 'unknown' END AS status FROM part")
def n17(t: Tables):
    model = F.when(c("p_partkey") % 2 == 0, "Cisco Catalyst 9300-48P").otherwise("2960")
    return t.part.select("p_partkey", N.upgrade_advice(model, F.lit("IOS XE"), F.concat(F.lit("17."), c("p_size").cast("string"), F.lit(".1")), F.lit("17.15.5")).alias("status"))


def _revisions(t: Tables):
    k = c("p_partkey")
    none = F.lit(None).cast("string")
    low = F.when(k % 3 != 0, F.concat(F.lit("17."), c("p_size").cast("string"), F.lit(".1")))
    return t.part.select(
        k.alias("revision_id"), F.lit("command").alias("kind"), F.lower("p_brand").alias("vendor_slug"), F.when(k % 2 == 0, "ios-xe").otherwise("linux").alias("os_slug"), F.when(k % 4 == 0, "x").alias("platform_slug"),
        F.when(k % 5 == 0, "portable").alias("portable_key"), c("p_name").alias("command"), F.expr("cast(array() as array<string>)").alias("procedure"), none.alias("title"), low.alias("version_min"), F.when(k % 3 == 1, low).alias("version_max"),
    )


@query(
    "v10_applicability_index",
    "SELECT p_partkey AS revision_id, CASE WHEN p_partkey % 2 = 0 THEN regexp_replace(lower(p_brand), '[^a-z0-9-]+', '-', 'g') || '-ios-xe' ELSE 'linux-userspace' END AS family, CASE WHEN p_partkey % 5 = 0 THEN 'os_family' WHEN p_partkey % 4 = 0 THEN 'model' ELSE 'vendor_os' END AS scope_level, CASE p_partkey % 3 WHEN 0 THEN 'unbounded' WHEN 1 THEN 'exact' ELSE 'range' END AS version_scope, CASE WHEN p_partkey % 3 = 1 AND p_partkey % 2 = 0 THEN '17.' || p_size END AS version_branch FROM part",
)
def v10(t: Tables):
    return N.applicability_index(_revisions(t)).select("revision_id", "family", "scope_level", "version_scope", "version_branch")


@query("v11_index_rebuild", "SELECT scope_level, version_scope, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'os_family' WHEN p_partkey % 4 = 0 THEN 'model' ELSE 'vendor_os' END AS scope_level, CASE p_partkey % 3 WHEN 0 THEN 'unbounded' WHEN 1 THEN 'exact' ELSE 'range' END AS version_scope FROM part) GROUP BY 1, 2")
def v11(t: Tables):
    return N.applicability_index(_revisions(t)).groupBy("scope_level", "version_scope").agg(F.count("*").alias("n"))


@query(
    "v11_resumed_rebuild",
    "SELECT p_partkey AS revision_id, CASE WHEN p_partkey % 5 = 0 THEN 'os_family' WHEN p_partkey % 4 = 0 THEN 'model' ELSE 'vendor_os' END AS scope_level, CASE p_partkey % 3 WHEN 0 THEN 'unbounded' WHEN 1 THEN 'exact' ELSE 'range' END AS version_scope, 'portable-v2' AS classifier FROM part",
)
def v11_resumed(t: Tables):
    """A rebuild in 16 parts that stops after one round of five and is resumed."""
    path = shared_path(t.spark, "reindex")
    N.Reindex(t.spark, path, "portable-v2", 16).run(_revisions(t), 5, 1)
    again = N.Reindex(t.spark, path, "portable-v2", 16)
    again.run(_revisions(t))
    return again.index().select("revision_id", "scope_level", "version_scope", "classifier")


@query("v12_missing_families", "SELECT DISTINCT lower(p_brand) AS vendor_slug, p_type AS os_slug FROM part WHERE (p_brand, p_type) NOT IN (SELECT (p_brand, p_type) FROM part WHERE p_size > 45 AND p_partkey % 2 = 0)")
def v12(t: Tables):
    s = t.part.select(F.lower("p_brand").alias("vendor_slug"), c("p_type").alias("os_slug"), "p_size", "p_partkey")
    return N.missing_families(s.drop("p_size", "p_partkey").distinct(), s.where("p_size > 45 and p_partkey % 2 = 0")).select("vendor_slug", "os_slug")


@query("v13_family_breakdown", "SELECT CASE WHEN p_partkey % 2 = 0 THEN regexp_replace(lower(p_brand), '[^a-z0-9-]+', '-', 'g') || '-ios-xe' ELSE 'linux-userspace' END AS family, count(*) AS n FROM part GROUP BY 1")
def v13(t: Tables):
    return N.applicability_index(_revisions(t)).groupBy("family").agg(F.count("*").alias("n"))


@query("v15_system_intent", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'rescue' WHEN event_type = 'click' THEN 'install' END AS mode, CASE WHEN event_type = 'signup' THEN NULL ELSE 'ONIE' END AS family FROM events")
def v15(t: Tables):
    e = c("event_type")
    i = N.system_intent(F.when(e == "error", "ONIE Rescue").when(e == "click", "ONIE installer BusyBox").when(e == "signup", " ").otherwise("ONIE"))
    return t.events.select("event_id", i["mode"].alias("mode"), i["family"].alias("family"))


_SIM = "round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b)))::DOUBLE, 6)"
_PAIRS = f"(SELECT k, n_name, {_SIM} AS similarity FROM (SELECT s_suppkey AS k, 'the ' || n2.n_name || ' ' || s_suppkey % 3 AS x FROM supplier JOIN nation n2 ON s_nationkey = n2.n_nationkey) q, nation, LATERAL (SELECT {_TRI.format('q.x')} AS a, {_TRI.format('nation.n_name')} AS b))"


def _requests(t: Tables):
    return t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey")).select(c("s_suppkey").alias("k"), F.concat(F.lit("the "), "n_name", F.lit(" "), (c("s_suppkey") % 3).cast("string")).alias("x"))


@query("j13_fuzzy_join", f"SELECT k, n_name, similarity FROM {_PAIRS} WHERE similarity >= 0.3")
def j13(t: Tables):
    return N.fuzzy_join(_requests(t), t.nation, "k", "x", "n_name", "n_name").withColumn("similarity", F.round("similarity", 6))


@query("v14_context_resolution", f"SELECT k, n_name FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY similarity DESC, n_name) AS r FROM {_PAIRS}) WHERE r = 1 AND similarity >= 0.5")
def v14(t: Tables):
    return N.resolved_context(_requests(t), t.nation.withColumn("alias", c("n_name")), "k", "x", "n_name", "alias").select("k", "n_name")


# a customer asks: for the nation of a supplier or its own, for that supplier, for a region or a nation's system
_ASKS = """WITH q AS MATERIALIZED (SELECT c_custkey AS request_id, CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'the ' || n.n_name WHEN 2 THEN 'unknown maker' ELSE n.n_name END AS vendor, CASE WHEN c_custkey % 5 > 0 THEN s_name || CASE WHEN c_custkey % 3 = 1 THEN 'X' ELSE '' END END AS model,
    CASE c_custkey % 4 WHEN 1 THEN r_name WHEN 2 THEN n.n_name || ' os' WHEN 3 THEN left(r_name, 4) END AS system, CASE WHEN c_custkey % 8 = 1 THEN 'rescue' END AS mode, c_custkey % 2 = 0 AS versioned
  FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % 10 JOIN nation n ON n.n_nationkey = CASE WHEN c_custkey % 2 = 0 THEN coalesce(s_nationkey, c_nationkey) ELSE c_nationkey END JOIN region ON r_regionkey = n_regionkey)"""
_ALIKE = "coalesce(len(list_intersect(a, b))::DOUBLE / nullif(len(list_distinct(list_concat(a, b))), 0)::DOUBLE, 0)"


def _alike_sql(name: str, text: str, catalogue: str, target: str, alias: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT x, t, s FROM (SELECT x, {target} AS t, CASE WHEN lower(x) = lower({alias}) THEN 1.0::DOUBLE ELSE {_ALIKE} END AS s
    FROM (SELECT DISTINCT {text} AS x FROM q WHERE {text} IS NOT NULL) z, {catalogue}, LATERAL (SELECT {_TRI.format('z.x')} AS a, {_TRI.format(alias)} AS b)) WHERE s >= 0.3)"""


@query(
    "v14_joint_context",
    f"""{_ASKS}, {_alike_sql('va', 'vendor', 'nation', 'n_nationkey', 'n_name')}, {_alike_sql('pa', 'model', 'supplier', 's_suppkey', 's_name')}, {_alike_sql('fa', 'system', 'region', 'r_regionkey', 'r_name')},
    {_alike_sql('sa', 'system', "(SELECT n_nationkey, n_name || ' os' AS o FROM nation) y", 'n_nationkey', 'o')},
    v AS (SELECT x, arg_min(t, (-s, t)) AS vendor_id, max(s) AS vs FROM va GROUP BY 1 HAVING max(s) >= 0.5), f AS (SELECT x, arg_min(t, (-s, t)) AS named, max(s) AS fs FROM fa GROUP BY 1),
    r AS MATERIALIZED (SELECT q.*, vendor_id, vs, named, fs FROM q LEFT JOIN v ON v.x = vendor LEFT JOIN f ON f.x = system),
    p AS (SELECT request_id, arg_min(t, (-s, t)) AS platform_id, max(s) AS ps FROM r JOIN pa ON pa.x = model JOIN supplier ON s_suppkey = t AND s_nationkey = vendor_id GROUP BY 1),
    o AS (SELECT request_id, vendor_id AS system_id FROM r WHERE vendor_id IS NOT NULL AND (system IS NULL OR EXISTS (SELECT 1 FROM sa WHERE sa.x = system AND sa.t = vendor_id))),
    w AS (SELECT r.*, platform_id, ps, system_id, coalesce(named, n_regionkey) AS family_id, CASE WHEN named IS NOT NULL THEN fs WHEN system_id IS NOT NULL THEN 1.0::DOUBLE END AS score FROM r LEFT JOIN p ON p.request_id = r.request_id LEFT JOIN o ON o.request_id = r.request_id LEFT JOIN nation ON n_nationkey = system_id)
    SELECT request_id, CASE WHEN named IS NOT NULL AND fs < 0.55 THEN 'os_not_resolved' WHEN vendor_id IS NULL AND coalesce(named, -1) <> 2 THEN 'vendor_not_resolved' WHEN family_id IS NULL OR score < 0.55 OR (family_id <> 2 AND system_id IS NULL) THEN 'os_not_resolved' ELSE 'resolved' END AS status,
      vendor_id, platform_id, system_id, family_id, mode, round(least(coalesce(vs, 0.6::DOUBLE), coalesce(ps, CASE WHEN model IS NULL THEN 0.7 ELSE 0.6 END::DOUBLE), score), 6) AS confidence,
      array_to_string(list_filter([CASE WHEN vendor IS NOT NULL AND vendor_id IS NULL THEN 'vendor_unmatched' END, CASE WHEN model IS NOT NULL AND platform_id IS NULL THEN 'model_unmatched' END, CASE WHEN NOT versioned THEN 'version_missing' END, CASE WHEN mode IS NOT NULL THEN 'mode_separated' END], lambda x: x IS NOT NULL), ',') AS ambiguities FROM w""",
)
def v14_joint(t: Tables):
    """Nations are vendors with one system each, suppliers their platforms, regions the families, of which the third is portable."""
    k = c("c_custkey")
    base = t.customer.join(t.supplier.select("s_suppkey", "s_name", "s_nationkey"), c("s_suppkey") == k % 10, "left")
    base = base.withColumn("_n", F.when(k % 2 == 0, F.coalesce("s_nationkey", "c_nationkey")).otherwise(c("c_nationkey"))).join(t.nation, c("n_nationkey") == c("_n")).join(t.region, c("r_regionkey") == c("n_regionkey"))
    system = F.when(k % 4 == 1, F.concat(F.when(k % 8 == 1, "rescue ").otherwise(""), "r_name")).when(k % 4 == 2, F.concat("n_name", F.lit(" os"))).when(k % 4 == 3, F.substring("r_name", 1, 4))
    asked = base.select(
        k.alias("request_id"), F.when(k % 7 == 0, None).when(k % 7 == 1, F.concat(F.lit("the "), "n_name")).when(k % 7 == 2, "unknown maker").otherwise(c("n_name")).alias("vendor"),
        F.when(k % 5 > 0, F.concat("s_name", F.when(k % 3 == 1, "X").otherwise(""))).alias("model"), system.alias("system"), F.when(k % 2 == 0, "1.0").alias("version"),
    )
    vendors = t.nation.select(c("n_nationkey").alias("vendor_id"), c("n_name").alias("alias"))
    platforms = t.supplier.select(c("s_suppkey").alias("platform_id"), c("s_nationkey").alias("vendor_id"), c("s_name").alias("alias"))
    systems = t.nation.select(c("n_nationkey").alias("system_id"), c("n_nationkey").alias("vendor_id"), c("n_regionkey").alias("family_id"), F.concat("n_name", F.lit(" os")).alias("alias"))
    families = t.region.select(c("r_regionkey").alias("family_id"), c("r_name").alias("alias"), (c("r_regionkey") == 2).alias("portable"))
    out = N.joint_context(asked, vendors, platforms, systems, families)
    return out.withColumns({"confidence": F.round("confidence", 6), "ambiguities": F.array_join("ambiguities", ",")})
