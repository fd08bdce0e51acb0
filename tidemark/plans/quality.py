"""Inventory Q, X, N6 to N8 over tables derived from ``part``, ``orders``, ``documents`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import quality as Q
from .registry import Tables, query

c = F.col


@query("q2_optional_fields", "SELECT p_partkey, CASE WHEN length(p_type) BETWEEN 1 AND 16 THEN p_type END AS mode FROM part")
def q2(t: Tables):
    return t.part.select("p_partkey", Q.optional_text(c("p_type"), 16).alias("mode"))


@query("q3_trusted_hash", "SELECT p_partkey, sha256(p_name) AS content_hash, p_partkey % 3 = 0 AS rebound FROM part")
def q3(t: Tables):
    frags = t.part.select(c("p_partkey").alias("fragment_id"), F.sha2("p_name", 256).alias("content_hash"))
    cands = t.part.select("p_partkey", c("p_partkey").alias("fragment_id"), F.when(c("p_partkey") % 3 == 0, "claimed").otherwise(F.sha2("p_name", 256)).alias("content_hash"))
    return Q.bind_hashes(cands, frags).select("p_partkey", "content_hash", "rebound")


def _candidates(t: Tables):
    k = c("p_partkey")
    return t.part.select(
        "p_partkey",
        F.when(k % 5 != 0, c("p_name")).alias("command"),
        F.when(k % 2 == 0, F.array("p_type")).otherwise(F.expr("cast(array() as array<string>)")).alias("procedure"),
        (k % 3 == 0).alias("dangerous"),
        F.when(k % 7 < 4, "safe_read_only").otherwise("changes_config").alias("risk_level"),
        F.when(k % 4 == 0, "model").when(k % 4 == 1, "architecture").otherwise("os_family").alias("applicability_scope"),
        F.when(k % 8 != 0, c("p_brand")).alias("platform_slug"),
        F.when(k % 8 == 1, "arm").alias("architecture_slug"),
        F.when(k % 6 == 0, "branch").otherwise("unbounded").alias("version_scope"),
        F.when(k % 12 == 0, "17.9").alias("version_branch"),
        ((c("p_size") * 2 + 880) / 1000.0).alias("confidence"),
        (k % 4).cast("int").alias("rollback_steps"),
    )


_K = "p_partkey"


@query(
    "q6_network_rules",
    "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 5 = 0 AND p_partkey % 2 <> 0 THEN 'NETWORK_CONTENT_REQUIRED' END, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 7 < 4 THEN 'NETWORK_DANGEROUS_FALSE_SAFE' END, CASE WHEN p_partkey % 8 = 0 THEN 'NETWORK_MODEL_SCOPE_REQUIRES_PLATFORM' END, CASE WHEN p_partkey % 4 = 1 AND p_partkey % 8 <> 1 THEN 'NETWORK_ARCHITECTURE_SCOPE_REQUIRES_ARCHITECTURE' END, CASE WHEN p_partkey % 6 = 0 AND p_partkey % 12 <> 0 THEN 'NETWORK_BRANCH_SCOPE_REQUIRES_BRANCH' END], lambda x: x IS NOT NULL), ',') AS issues FROM part",
)
def q6(t: Tables):
    df = _candidates(t)
    return df.select("p_partkey", F.array_join(Q.network_rules(df), ",").alias("issues"))


@query(
    "q7_measurement_rules",
    "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 2 = 0 THEN 'UNIT_DIMENSION_MISMATCH' END, CASE WHEN p_partkey % 2 = 0 THEN 'TOLERANCE_UNIT_MISMATCH' END, CASE WHEN p_size < 10 OR p_size > p_partkey % 50 THEN 'NOMINAL_OUTSIDE_TOLERANCE' END, CASE WHEN p_partkey % 50 < 10 THEN 'TOLERANCE_BOUNDS_REVERSED' END], lambda x: x IS NOT NULL), ',') AS issues FROM part",
)
def q7(t: Tables):
    none = F.lit(None).cast("string")
    df = t.part.select(
        "p_partkey", F.lit("tolerance").alias("record_type"), F.lit("length").alias("dimension"), F.concat(c("p_size").cast("string"), F.lit(".000")).alias("value"), F.lit("mm").alias("unit"), F.lit("bounds").alias("tol_type"),
        F.lit("10.0").alias("lower"), (c("p_partkey") % 50).cast("string").alias("upper"), none.alias("minus"), none.alias("plus"), F.when(c("p_partkey") % 2 == 0, "kg").otherwise("mm").alias("tol_unit"),
        none.alias("factor"), none.alias("input_unit"), none.alias("output_unit"),
    )
    return Q.MeasurementPack().validate(df).select("p_partkey", F.array_join("issues", ",").alias("issues"))


@query("q8_exact_decimals", "SELECT p_partkey, CASE WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END AS cmp FROM (SELECT p_partkey, p_retailprice::DECIMAL(18,2) - 900 AS a, (p_size * 2)::DECIMAL(18,2) AS b FROM part)")
def q8(t: Tables):
    a = (c("p_retailprice").cast("decimal(18,2)") - F.lit(900).cast("decimal(18,0)")).cast("string")
    return t.part.select("p_partkey", Q.compare_decimals(a, (c("p_size") * 2).cast("string")).alias("cmp"))


@query(
    "q9_publication_gate",
    "SELECT p_partkey, array_to_string(list_filter([CASE WHEN (p_size * 2 + 880)::DOUBLE / 1000.0::DOUBLE < CASE WHEN p_partkey % 3 = 0 THEN 0.95 ELSE 0.9 END THEN 'CONFIDENCE_BELOW_PUBLICATION_THRESHOLD' END, CASE WHEN p_partkey % 12 = 0 THEN 'DANGEROUS_CANDIDATE_REQUIRES_ROLLBACK' END, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 7 < 4 THEN 'DANGEROUS_CANDIDATE_FALSE_SAFE' END], lambda x: x IS NOT NULL), ',') AS issues FROM part",
)
def q9(t: Tables):
    return _candidates(t).select("p_partkey", F.array_join(Q.gate(), ",").alias("issues"))


@query("q10_shape_checks", "SELECT c_custkey, array_to_string(list_filter([CASE WHEN length(c_name) > 17 THEN 'SHAPE_C_NAME' END, CASE WHEN NOT regexp_matches(c_mktsegment, '^[A-M]') THEN 'SHAPE_C_MKTSEGMENT' END], lambda x: x IS NOT NULL), ',') AS issues FROM customer")
def q10(t: Tables):
    return t.customer.select("c_custkey", F.array_join(Q.shape_issues({"c_name": (1, 17, None), "c_mktsegment": (1, 80, "^[A-M]")}), ",").alias("issues"))


@query(
    "q11_catalogue_disposition",
    "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'deep_review:vendor' WHEN p_size > 40 THEN 'deep_review:operating_system' WHEN p_partkey % 7 = 1 THEN 'deep_review:platform' WHEN p_partkey % 4 = 0 AND p_partkey % 3 <> 0 THEN 'conflict:kind' END AS disposition FROM part",
)
def q11(t: Tables):
    k = c("p_partkey")
    brands = t.part.select(c("p_brand").alias("vendor_slug")).distinct()
    cands = t.part.select(
        "p_partkey", F.when(k % 5 == 0, "nobody").otherwise(c("p_brand")).alias("vendor_slug"), c("p_size").cast("string").alias("os_slug"), F.when(k % 7 == 1, "missing").when(k % 7 == 2, c("p_brand")).alias("platform_slug"),
        k.cast("string").alias("stable_key"), F.when(k % 3 == 0, "command").otherwise("procedure").alias("kind"),
    )
    systems = brands.join(t.part.where("p_size <= 40").select(c("p_size").cast("string").alias("os_slug")).distinct())
    items = t.part.where(k % 4 == 0).select(k.cast("string").alias("stable_key"), F.lit("command").alias("kind"))
    return Q.catalogue_disposition(cands, brands, systems, brands.withColumn("platform_slug", c("vendor_slug")), items).select("p_partkey", "disposition")


@query(
    "q12_verification_decision",
    "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'rejected' WHEN p_partkey % 5 = 0 THEN 'conflict' WHEN p_size < 20 THEN 'deep_review' ELSE 'verified' END AS decision FROM part",
)
def q12(t: Tables):
    k = c("p_partkey")
    decision = F.when(k % 4 == 0, "rejected").otherwise("verified")
    return t.part.select("p_partkey", Q.final_decision(decision, F.when(k % 5 == 0, "conflict:kind"), F.when(c("p_size") < 20, 0.5).otherwise(0.99), F.lit(0.9), k % 3 == 0).alias("decision"))


@query("q13_omitted_decisions", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def q13(t: Tables):
    return Q.omitted(t.orders.select("o_orderkey"), t.lineitem.where("l_returnflag = 'R'").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")


@query("q14_patch_merge", "SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_name END AS p_name, CASE WHEN p_partkey % 2 = 0 THEN 'patched' ELSE p_type END AS p_type FROM part")
def q14(t: Tables):
    k = c("p_partkey")
    clear = F.when(k % 3 == 0, F.array(F.lit("p_name"))).otherwise(F.expr("cast(array() as array<string>)"))
    patches = t.part.where(k % 2 == 0).select("p_partkey", clear.alias("clear"), F.lit(None).cast("string").alias("p_name"), F.lit("patched").alias("p_type"))
    return Q.patched(t.part.select("p_partkey", "p_name", "p_type"), patches, "p_partkey", ["p_name", "p_type"])


@query("q15_review_outcome", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'deep_review' ELSE 'rejected' END AS outcome FROM part")
def q15(t: Tables):
    return t.part.select("p_partkey", Q.review_outcome(F.when(c("p_partkey") % 2 == 0, "low").otherwise("medium")).alias("outcome"))


@query("q17_unique_documents", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r = 1")
def q17(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.when(c("l_returnflag") == "R", "primary").when(c("l_returnflag") == "A", "corroborating").otherwise("conflict").alias("role"), F.struct("l_linenumber", "l_partkey").alias("o"))
    return Q.unique_documents(rows, ["l_orderkey"], "role", "o").select("l_orderkey", "l_linenumber")


@query("q18_scoped_key", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || '.scope-' || left(sha256(p_brand || chr(0) || 'all-platforms'), 12) ELSE p_name END AS stable_key FROM (SELECT p_partkey, p_brand, 'k' || p_partkey AS p_name FROM part)")
def q18(t: Tables):
    k = c("p_partkey")
    name = F.concat(F.lit("k"), k.cast("string")).alias("stable_key")
    cands = t.part.select("p_partkey", "p_brand", name, F.lit(None).cast("string").alias("platform"))
    return Q.scoped_keys(cands, t.part.where(k % 2 == 0).select(name), [("p_brand", ""), ("platform", "all-platforms")]).select("p_partkey", "stable_key")


@query("q19_trust", "SELECT o_orderkey, coalesce(n, 0)::BIGINT AS confirmations, (o_orderdate::DATE + CASE WHEN o_orderstatus = 'F' THEN 90 ELSE 180 END)::DATE::VARCHAR AS next_review FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT (l_suppkey, l_returnflag)) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def q19(t: Tables):
    revs = t.orders.select("o_orderkey", (c("o_orderstatus") == "F").alias("dangerous"), F.to_date("o_orderdate").alias("verified_at"))
    prov = t.lineitem.select(c("l_orderkey").alias("o_orderkey"), c("l_suppkey").cast("string").alias("url"), c("l_returnflag").alias("content_hash"))
    return Q.trust(revs, prov, "o_orderkey").withColumn("next_review", c("next_review").cast("string"))


@query("q20_legacy_transform", "SELECT s_suppkey, left(regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 63) AS slug, least(1.0, greatest(0.0, s_acctbal / 10000.0)) AS confidence FROM supplier")
def q20(t: Tables):
    return t.supplier.select("s_suppkey", Q.slug(c("s_name")).alias("slug"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("s_acctbal") / 10000.0)).alias("confidence"))


@query("q21_new_dimensions", "SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def q21(t: Tables):
    return Q.new_members(t.customer.select(c("c_nationkey").alias("k")), t.supplier.where("s_acctbal > 9000").select(c("s_nationkey").alias("k")), ["k"])


@query("q22_import_ledger", "SELECT o_custkey AS k, CASE WHEN bool_or(o_orderstatus = 'O') THEN 'imported' ELSE 'reviewed' END AS trust FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def q22(t: Tables):
    fresh = t.orders.where("o_orderstatus = 'O'").select(c("o_custkey").alias("k"), "o_orderpriority").dropDuplicates(["k"])
    old = t.orders.where("o_orderstatus = 'F'").select(c("o_custkey").alias("k"), F.lit("reviewed").alias("trust")).distinct()
    return Q.ledger(fresh, old, "k", "o_orderpriority", ["none"])


@query("q23_conservation", "SELECT (SELECT count(*) FROM orders) AS seen, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS imported, (SELECT count(*) FROM orders) = (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS conserved")
def q23(t: Tables):
    return Q.conservation(seen=t.orders, imported=t.lineitem.select("l_orderkey").distinct())


@query("q24_conformance")
def q24(t: Tables):
    df = _candidates(t).withColumn("expected", F.when(c("dangerous") & (c("risk_level") == "safe_read_only"), F.array(F.lit("DANGEROUS_CANDIDATE_FALSE_SAFE"))).otherwise(F.expr("cast(array() as array<string>)")))
    return Q.conformance(df, Q.gate(), "expected", ["CONFIDENCE_BELOW_PUBLICATION_THRESHOLD", "DANGEROUS_CANDIDATE_REQUIRES_ROLLBACK", "DANGEROUS_CANDIDATE_FALSE_SAFE"])


@query("q25_canonical_hash", "SELECT p_partkey, sha256('{\"p_brand\":\"' || p_brand || '\",\"p_name\":\"' || p_name || '\",\"p_size\":' || p_size || '}') AS h FROM part")
def q25(t: Tables):
    return t.part.select("p_partkey", Q.canonical_hash(["p_size", "p_name", "p_brand"]).alias("h"))


@query("q26_evidence_rules", "SELECT event_id, array_to_string(list_filter([CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 'EXPIRED' END, CASE WHEN event_type = 'error' THEN 'CHECK_FAILED' END, CASE WHEN value < 1 THEN 'IMAGE_MISSING' END], lambda x: x IS NOT NULL), ',') AS issues FROM events")
def q26(t: Tables):
    rules = {"EXPIRED": c("ts") < F.lit("2024-01-10").cast("timestamp_ntz"), "CHECK_FAILED": c("event_type") == "error", "IMAGE_MISSING": c("value") < 1}
    return t.events.select("event_id", F.array_join(Q.issues(rules), ",").alias("issues"))


@query("q27_safety_repair", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'skip:not_read_only' WHEN p_size < 25 THEN 'skip:no_evidence' ELSE 'repair' END AS action FROM part")
def q27(t: Tables):
    lines = F.array(F.when(c("p_partkey") % 2 == 0, "reload in 5").otherwise("show version"))
    revs = t.part.withColumn("dangerous", F.lit(True))
    return Q.safety_repairs(revs, t.part.where("p_size >= 25").select("p_partkey"), "p_partkey", lines)


@query("q28_bulk_repair", "SELECT o_orderstatus, count(*) AS n, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS changed FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS o_orderstatus FROM orders) GROUP BY 1")
def q28(t: Tables):
    new, before = Q.bulk_repair(t.orders, "o_orderstatus", c("o_orderstatus") == "P", "O")
    return new.groupBy("o_orderstatus").agg(F.count("*").alias("n")).join(F.broadcast(before.agg(F.count("*").alias("changed"))))


@query("q30_batch_completeness", "SELECT count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag IN ('R', 'A'))) AS missing, 0::BIGINT AS extra, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag IN ('R', 'A'))) = 0 AS complete FROM orders")
def q30(t: Tables):
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    return Q.completeness(t.orders, lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'A'"), "o_orderkey")


@query("q31_rebinding", "SELECT min(doc_id) AS candidate_id, count(DISTINCT source) > 0 AS bound FROM documents GROUP BY text")
def q31(t: Tables):
    sources = t.documents.select(c("source").alias("source_id")).distinct().select("source_id", c("source_id").alias("url"), F.sha2("source_id", 256).alias("source_hash"), F.expr("cast(array() as array<string>)").alias("terms"))
    return Q.rebound(t.documents.select(c("doc_id").alias("candidate_id"), c("source").alias("source_id"), "text"), sources).select("candidate_id", c("url").isNotNull().alias("bound"))


@query("q32_leaks", r"SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') THEN 'private_key' END, CASE WHEN regexp_matches(text, '(?i)\bbearer\s+[A-Za-z0-9._~+/=-]{16,}') THEN 'bearer' END, CASE WHEN regexp_matches(text, '\b(?:sk|ghp|gho|xox[abp])[-_][A-Za-z0-9_-]{16,}|\bAKIA[0-9A-Z]{16}\b') THEN 'token' END], lambda x: x IS NOT NULL), ',') AS kinds FROM documents")
def q32(t: Tables):
    return t.documents.select("doc_id", F.array_join(Q.leaks(c("text")), ",").alias("kinds"))


@query("x2_extractor", "SELECT p_partkey, place, command, 'reference.' || regexp_replace(lower(command), '[^a-z0-9]+', '-', 'g') AS stable_key, CASE place WHEN 0 THEN 'diagnostic' ELSE 'command' END AS kind, CASE place WHEN 0 THEN 'safe_read_only' WHEN 1 THEN 'service_disruptive' ELSE 'changes_config' END AS risk_level, place > 0 AS dangerous FROM (SELECT p_partkey, unnest([0, 1, 2])::INT AS place, unnest(['show version ' || p_brand, 'reload in ' || p_size, 'interface eth' || p_partkey % 10]) AS command FROM part)")
def x2(t: Tables):
    lines = [F.concat(F.lit("• show version "), "p_brand"), F.lit("It ends with a reload."), F.concat(F.lit("2) reload in "), c("p_size").cast("string")), F.concat(F.lit("interface eth"), (c("p_partkey") % 10).cast("string"))]
    return Q.extracted(t.part.select("p_partkey", F.concat_ws("\n", *lines).alias("content")), "p_partkey")


@query("x3_installed_packs", "SELECT p_partkey FROM part WHERE p_size >= 20 AND p_partkey % 2 = 0")
def x3(t: Tables):
    k = c("p_partkey").cast("string").alias("name")
    manifests = t.part.select(k, "p_partkey", F.concat(F.lit("1."), c("p_size").cast("string"), F.lit(".0")).alias("version"))
    catalogue = t.part.select(k, F.lit("1.20.0").alias("version"), (c("p_partkey") % 2 == 0).alias("enabled"))
    return Q.installed(manifests, catalogue).select("p_partkey")


@query("x4_semver", "SELECT p_partkey, p_size % 3 = 1 AND (p_size > 10 OR (p_size = 10 AND p_partkey % 9 >= 4)) AS ok FROM part")
def x4(t: Tables):
    v = F.concat_ws(".", (c("p_size") % 3).cast("string"), c("p_size").cast("string"), (c("p_partkey") % 9).cast("string"))
    return t.part.select("p_partkey", Q.compatible(v, F.lit("1.10.4")).alias("ok"))


@query("n6_payload_redaction", "SELECT event_id, '{\"k\":\"[REDACTED]\"}' AS props FROM events")
def n6(t: Tables):
    return Q.redact_json(t.events.select("event_id", "props"), "props", ["k"])


@query("n7_mask_leaves", "SELECT event_id, '{\"k\":\"[MASKED]\"}' AS props FROM events")
def n7(t: Tables):
    return Q.redact_json(t.events.select("event_id", "props"), "props", [], mask_all=True)


@query("n8_table_mask", "SELECT c_custkey, 'redacted' AS c_name, 0::DOUBLE AS c_acctbal, c_mktsegment FROM customer")
def n8(t: Tables):
    return Q.masked_table(t.customer, {"c_name": "redacted", "c_acctbal": 0}).select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@query("p10_actionable", "SELECT p_partkey FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0 OR p_partkey % 5 = 0")
def p10(t: Tables):
    from ..operators.search import actionable

    k = c("p_partkey")
    asked = F.when(k % 2 == 0, "what is the state").otherwise("how to upgrade it")
    command = F.when(k % 3 == 0, "show version; reload").otherwise("show version\nping 10.0.0.1")
    steps = F.when(k % 5 == 0, F.array(F.lit("step"))).otherwise(F.expr("cast(array() as array<string>)"))
    return actionable(t.part, asked, command, steps).select("p_partkey")


@query("d16_candidate_synthesis", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'show run ' || user_id ELSE 'interface Gi' || user_id END AS command, 'reference.' || CASE WHEN event_type = 'view' THEN 'show-run-' || user_id ELSE 'interface-gi' || user_id END AS stable_key, CASE WHEN event_type = 'view' THEN 'diagnostic' ELSE 'command' END AS kind, CASE WHEN event_type = 'view' THEN 'safe_read_only' ELSE 'changes_config' END AS risk_level FROM events WHERE event_type IN ('view', 'click')")
def d16(t: Tables):
    e, n = c("event_type"), c("user_id").cast("string")
    content = F.when(e == "view", F.concat(F.lit("Text.\n1. show  run "), n)).when(e == "click", F.concat(F.lit("• interface Gi"), n)).otherwise("none here")
    rows = t.events.select("event_id", content.alias("content"))
    return Q.extracted(rows, "event_id").select("event_id", "command", "stable_key", "kind", "risk_level")


@query("q5_risk_escalation", "SELECT event_id, CASE event_type WHEN 'error' THEN 'service_disruptive' WHEN 'view' THEN 'changes_config' WHEN 'click' THEN 'factory_reset' ELSE 'unknown' END AS risk FROM events")
def q5(t: Tables):
    e = c("event_type")
    line = F.when(e == "error", "reload").when(e == "view", "show run").when(e == "click", "write erase").otherwise("frobnicate")
    return t.events.select("event_id", T.escalated(F.lit("changes_config"), T.risk(F.array(line))).alias("risk"))


@query("q29_diagnosis_records", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS capability, CASE WHEN p_size > 25 THEN 'security_advisories' ELSE p_brand END AS role, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS vendor FROM part")
def q29(t: Tables):
    df = t.part.select(
        "p_partkey", F.array("p_name").alias("caps"), F.array(F.when(c("p_size") > 25, "Security Advisory").otherwise(c("p_brand"))).alias("roles"), F.when(c("p_partkey") % 2 == 0, F.concat(F.lit(" "), "p_type")).otherwise("  ").alias("vendor")
    )
    return Q.normalised_diagnoses(df, "caps", "roles", ["vendor"]).select("p_partkey", c("caps")[0].alias("capability"), c("roles")[0].alias("role"), "vendor")


@query("x1_domain_pack", "SELECT p_partkey, NOT ((p_size * 2 + 880)::DOUBLE / 1000.0::DOUBLE < CASE WHEN p_partkey % 3 = 0 THEN 0.95 ELSE 0.9 END OR p_partkey % 12 = 0 OR (p_partkey % 3 = 0 AND p_partkey % 7 < 4)) AS valid FROM part")
def x1(t: Tables):
    return Q.Pack().validate(_candidates(t)).select("p_partkey", "valid")


@query("x5_current_validation", "SELECT DISTINCT ON (l_orderkey) l_orderkey AS revision_id, l_returnflag AS validation_type, l_shipdate AS executed_at FROM lineitem WHERE l_linestatus = 'F' AND l_shipdate > TIMESTAMP '1994-01-01' ORDER BY l_orderkey, list_position(['R', 'A', 'N'], l_returnflag), l_shipdate DESC")
def x5(t: Tables):
    passed = F.when(c("l_linestatus") == "F", "passed").otherwise("failed")
    vals = t.lineitem.select(c("l_orderkey").alias("revision_id"), passed.alias("status"), c("l_shipdate").alias("executed_at"), c("l_shipdate").alias("expires_at"), c("l_returnflag").alias("validation_type"))
    return Q.current_validation(vals, F.lit("1994-01-01").cast("timestamp_ntz"), ["R", "A", "N"]).select("revision_id", "validation_type", "executed_at")


@query(
    "x5_table_function",
    """SELECT o_orderkey AS revision_id, v.l_returnflag AS validation_level, v.l_shipdate AS lab_validated_at FROM orders JOIN
    (SELECT DISTINCT ON (l_orderkey) l_orderkey, l_returnflag, l_shipdate FROM lineitem WHERE l_linestatus = 'F' AND l_shipdate > TIMESTAMP '1994-01-01' ORDER BY l_orderkey, list_position(['R', 'A', 'N'], l_returnflag), l_shipdate DESC) v ON v.l_orderkey = o_orderkey""",
)
def x5_function(t: Tables):
    """The table function called by LATERAL for each order."""
    passed = F.when(c("l_linestatus") == "F", "passed").otherwise("failed")
    Q.register_current_validation(t.lineitem.select(c("l_orderkey").alias("revision_id"), passed.alias("status"), c("l_returnflag").alias("validation_type"), c("l_shipdate").alias("executed_at"), c("l_shipdate").alias("expires_at")), ("R", "A", "N"))
    t.orders.createOrReplaceTempView("revisions_of_orders")
    as_of = f"CAST('1994-01-01' AS {dict(t.lineitem.dtypes)['l_shipdate']})"
    return t.spark.sql(f"SELECT o_orderkey AS revision_id, validation_level, lab_validated_at FROM revisions_of_orders, LATERAL current_knowledge_validation(o_orderkey, {as_of})")
