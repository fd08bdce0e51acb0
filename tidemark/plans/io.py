"""Inventory S and T: sources, sinks and streams over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..operators import documents as D
from ..operators import quality as Q
from ..operators.releases import ReleaseLog
from ..sources import files as S
from ..streaming import jobs as J
from .registry import Tables, query

c = F.col


@query("s1_typed_json", "SELECT doc_id, lang, n_chars FROM documents")
def s1(t: Tables):
    path = S.shared_path(t.spark, "jsonl")
    t.documents.select("doc_id", "lang", "n_chars").write.json(path)
    return S.typed_json(t.spark, path, "doc_id long, lang string, n_chars long")


@query("s2_export_manifest", "SELECT 'lang' AS \"column\", lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2")
def s2(t: Tables):
    return S.export_json(t.documents.select("doc_id", "lang", "source"), S.shared_path(t.spark, "export"), ["lang", "source"])


@query("s3_document_landing", "SELECT count(*) AS pages FROM pages WHERE regexp_matches(html, '<[^>]+>')")
def s3(t: Tables):
    return D.page_text(t.pages).where("text <> html").agg(F.count("*").alias("pages"))


# Pages of a landed file.
_LANDED = 1000


@query("s3_landing_files", "SELECT CASE WHEN page_id % 3 = 0 THEN 'text/html' WHEN page_id % 3 = 1 THEN 'text/plain' ELSE 'application/octet-stream' END AS media_type, count(*) AS pages, sum(CASE WHEN page_id % 3 < 2 THEN octet_length(encode(replace(html, chr(10), ' '))) ELSE 0 END)::BIGINT AS bytes FROM pages GROUP BY 1")
def s3_files(t: Tables):
    """Pages written as files of three types, a page a line, and landed. A file is read as one value, so files are small, and its text is
    left behind where it is taken apart."""
    path, k = S.shared_path(t.spark, "landing"), c("page_id") % 3
    kind = F.when(k == 0, 0).when(k == 1, 1).otherwise(2)
    for n, ending in enumerate((".html", ".txt", ".bin")):
        rows = t.pages.where(kind == n).select(F.replace("html", F.lit("\n"), F.lit(" ")))
        rows.write.options(lineSep="\n", maxRecordsPerFile=_LANDED).text(f"{path}/{n}")
        S.renamed(t.spark, f"{path}/{n}", ending)
    lines = F.split(F.coalesce("text", c("content").cast("string")), "\n")  # a line ends with its separator, so the last piece is none
    whole = F.slice(lines, F.lit(1), F.size(lines) - 1)
    files = S.landing(t.spark, path, keep_content=True).select("media_type", c("text").isNotNull().alias("is_text"), whole.alias("lines"))
    landed = files.select("media_type", "is_text", F.explode("lines").alias("line"))
    return landed.groupBy("media_type").agg(F.count("*").alias("pages"), F.coalesce(F.sum(F.when(c("is_text"), F.octet_length("line"))), F.lit(0)).alias("bytes"))


@query("s4_fragment_sink", "SELECT doc_id, length(text) AS n FROM documents WHERE lang <> 'en'")
def s4(t: Tables):
    rows = t.documents.select("doc_id", F.lit(0).alias("ordinal"), T.content_hash(c("text")).alias("content_hash"), F.length("text").cast("long").alias("n"), "lang")
    return D.new_fragments(rows, rows.where("lang = 'en'"), "doc_id").select("doc_id", "n")


@query("s5_event_feed", "SELECT event_id, event_type, true AS has_more FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 50")
def s5(t: Tables):
    return S.feed_page(t.events.select("event_id", "event_type"), "event_id", 100, 50)


@query("s6_report_import", "SELECT o_orderkey AS revision_id FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 = 0 AND o_orderkey % 2 = 1")
def s6(t: Tables):
    k = c("o_orderkey")
    reports = t.orders.select(k.cast("string").alias("stable_key"), F.lit("abc").alias("commit"), c("o_orderstatus").alias("content_hash"), F.lit(3).alias("checks"), F.when(c("o_custkey") % 3 == 0, 3).otherwise(2).alias("passed"))
    active = t.orders.where("o_orderstatus = 'F'").select(k.cast("string").alias("stable_key"), c("o_orderstatus").alias("content_hash"), k.alias("revision_id"))
    stored = t.orders.where("o_orderkey % 2 = 0").select(k.alias("revision_id"), F.lit("abc").alias("commit"))
    return S.bound_reports(reports, active, stored, "abc").select("revision_id")


@query("s7_snapshot", "SELECT count(*) AS n, 'r2' AS release_id FROM events")
def s7(t: Tables):
    now = F.lit("2024-02-01").cast("timestamp")
    old = t.events.agg((F.count("*") * 0).alias("n")).withColumn("taken_at", now).withColumn("release_id", F.lit("r1"))
    return S.refresh_snapshot(old, t.events.agg(F.count("*").alias("n")), now, F.lit("r2")).select("n", "release_id")


@query("s8_inline_records", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def s8(t: Tables):
    return S.inline_records(t.events.select("event_id", F.concat(F.lit("["), "props", F.lit("]")).alias("records")), "records", "k: bigint")


@query("s9_contributions", "SELECT sha256(event_type) AS content_hash, max(ts) AS expires_at FROM events GROUP BY event_type")
def s9(t: Tables):
    rows = t.events.select("event_type", c("ts").alias("expires_at"))
    stored = rows.select(F.sha2("event_type", 256).alias("content_hash"), c("event_type").alias("sample"), "expires_at").limit(0)
    return S.contributions(rows, stored, T.redacted(c("event_type"), True)[0]).select("content_hash", "expires_at")


@query("s10_retention", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY")
def s10(t: Tables):
    return S.retained(t.events, "ts", F.lit("2024-01-31").cast("timestamp_ntz"), 14).select("event_id")


def _stream(t: Tables):
    """Events as a stream (a pattern, as a single file is no folder); the time zone of the session is UTC."""
    return J.file_stream(t.spark, f"{t.sf_dir}/events*.parquet").withColumn("ts", c("ts").cast("timestamp"))


@query("t1_continuous_ingest", "SELECT event_id, event_type FROM events WHERE value > 20")
def t1(t: Tables):
    path = S.shared_path(t.spark, "ingest")
    J.ingest(_stream(t), lambda b: b.where("value > 20").select("event_id", "event_type"), f"{path}/out", f"{path}/check").awaitTermination()
    return t.spark.read.schema("event_id long, event_type string").parquet(f"{path}/out/*")


# Fixed plan of the ingest: four files, a page in that of its number modulo four, each a batch.
_FILES = 4


def _page_files(t: Tables):
    """Pages with two command lines of their own, written as four files one after another."""
    path, k = S.shared_path(t.spark, "pages"), c("page_id")
    # a blank line before them: a block of their own, which no cut of a long text goes through
    lines = F.concat(F.lit("</p></p><p>• show interface Gi"), (k % 50).cast("string"), F.lit("</p><p>2) reload in "), (k % 20).cast("string"), F.lit("</p>"))
    for n in range(_FILES):
        t.pages.where(k % _FILES == n).select("page_id", F.concat(F.coalesce("html", F.lit("")), lines).alias("html")).coalesce(1).write.mode("append").parquet(path)
    return path


def ingest_steps(pages):
    """Pages to the best candidate of each item: D1, D9 to D13, X2, Q9."""
    text = D.page_text(pages)
    parts = D.fragments(text.select("page_id", "text"), "page_id")
    found = Q.extracted(parts.select(F.struct("page_id", "ordinal").alias("fragment"), "content"), "fragment")
    page = c("fragment.page_id")
    rated = found.withColumn("confidence", (900 + page % 100) / 1000.0).withColumn("rollback_steps", (page % 5).cast("int"))
    passed = rated.where(F.size(Q.gate()) == 0)
    best = F.min_by(page, F.struct(-c("confidence"), page))
    return passed.groupBy(c("stable_key").alias("item_id")).agg(best.cast("string").alias("revision_id"))


@query(
    "t1_published_releases",
    f"""WITH c AS (SELECT page_id, page_id % {_FILES} AS release, (900 + page_id % 100)::DOUBLE / 1000 AS confidence, unnest(['reference.show-interface-gi' || page_id % 50, 'reference.reload-in-' || page_id % 20]) AS item_id, unnest([false, true]) AS dangerous FROM pages),
    b AS (SELECT release, item_id, arg_min(page_id, (-confidence, page_id)) AS page FROM c WHERE confidence >= CASE WHEN dangerous THEN 0.95 ELSE 0.9 END AND NOT (dangerous AND page_id % 5 = 0) GROUP BY 1, 2)
    SELECT release::INT AS release, item_id, (lag(page) OVER (PARTITION BY item_id ORDER BY release))::VARCHAR AS previous_revision_id, page::VARCHAR AS new_revision_id FROM b""",
)
def t1_releases(t: Tables):
    path = S.shared_path(t.spark, "ingest")
    log = ReleaseLog(t.spark, f"{path}/log", 3)
    J.ingest_releases(J.file_stream(t.spark, _page_files(t), 1), ingest_steps, log, f"{path}/check").awaitTermination()
    return log.changes().select("release", "item_id", "previous_revision_id", "new_revision_id")


@query("t2_flush_rule", "SELECT count(*) AS pending, count(*) >= 50 AS flush FROM events WHERE event_type = 'error'")
def t2(t: Tables):
    return J.flush_ready(t.events.where("event_type = 'error'"), "ts", F.lit("2024-01-01").cast("timestamp_ntz")).select("pending", "flush")


@query("t3_readiness", "SELECT count(*) AS pending, count(*) >= 32 AS ready FROM events WHERE event_type = 'signup'")
def t3(t: Tables):
    return J.verification_ready(t.events.where("event_type = 'signup'"), "ts", F.lit(True), F.lit("2024-01-01").cast("timestamp_ntz")).select("pending", "ready")


_DAYS = "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, count(*) > 70 AS limited, greatest(70 - count(*), 0) AS remaining FROM events GROUP BY 1, 2"


# Fixed plan of the event stream: files of a batch, so that as many tasks write it.
_PARTS = 12


def _event_files(t: Tables, *columns: str):
    """Events written in four stretches, one after another in order of time, as a stream of a stretch a batch."""
    path, rows = S.shared_path(t.spark, "events"), t.events.select("ts", *columns)
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    rows = rows.withColumn("at", c("ts").cast("timestamp"))
    for n in range(_FILES):
        low, high = first + (last - first) * n / _FILES, first + (last - first) * (n + 1) / _FILES
        part = (c("ts") >= F.lit(low)) & ((c("ts") < F.lit(high)) if n < _FILES - 1 else F.lit(True))
        batch = rows.where(part).select(c("at").alias("ts"), *columns)
        batch.repartition(_PARTS).write.mode("append").parquet(path)
        for _ in range((n + 1) * _PARTS - len(t.spark.read.parquet(path).inputFiles())):  # few rows leave parts out
            batch.where("false").coalesce(1).write.mode("append").parquet(path)
    return J.file_stream(t.spark, path, _PARTS)


def _groups_sql(key: str, most: int, seconds: int) -> str:
    """Groups one after another: each row points to the first of the group after its own. The watermark is a second behind the last row."""
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT {key} AS k, epoch_us(ts) // 1000 AS tm, row_number() OVER (PARTITION BY {key} ORDER BY ts) AS i FROM events WHERE {key} IS NOT NULL),
    n AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY k ORDER BY tm RANGE BETWEEN UNBOUNDED PRECEDING AND {seconds * 1000 - 1} FOLLOWING) AS upto FROM e),
    g AS (SELECT k, i, tm, least({most}, upto - i + 1) AS size FROM n WHERE i = 1 UNION ALL SELECT n.k, n.i, n.tm, least({most}, n.upto - n.i + 1) FROM g JOIN n ON n.k = g.k AND n.i = g.i + g.size),
    r AS (SELECT g.k, g.tm, g.size, z.tm AS last FROM g JOIN e z ON z.k = g.k AND z.i = g.i + g.size - 1)
    SELECT k AS {key}, make_timestamp(tm * 1000) AS opened_at, make_timestamp((CASE WHEN size = {most} THEN last ELSE tm + {seconds * 1000} END) * 1000) AS closed_at, size AS n, CASE WHEN size = {most} THEN 'full' ELSE 'waited' END AS reason
    FROM r WHERE size = {most} OR tm + {seconds * 1000} <= (SELECT max(tm) - 1000 FROM e)"""


@query("t3_ready_groups", _groups_sql("event_type", 32, 21600))
def t3_groups(t: Tables):
    """Pending rows of a type go on 32 together, or after six hours."""
    out = J.drain(J.ready_groups(_event_files(t, "event_type"), "event_type", "ts", 32, 21600), "ready")
    return out.withColumns({x: c(x).cast("timestamp_ntz") for x in ("opened_at", "closed_at")})


@query("t4_rate_counts", _DAYS)
def t4(t: Tables):
    out = J.drain(J.rate_counts(_stream(t), "ts", ["event_type"], "1 day", 70, "40 days"), "rates", "update")
    rest = [x for x in out.columns if x != "batch"]
    last = out.withColumn("_r", F.row_number().over(W.partitionBy("start", "event_type").orderBy(F.desc("batch")))).where("_r = 1")
    return last.select(*rest).withColumn("start", c("start").cast("timestamp_ntz"))


@query("t5_trailing_failures", "SELECT event_id, n AS failures, CASE WHEN n < 4 THEN 0 ELSE least(300, 30 * 2 ** ((n - 4) // 4))::INT END AS cooldown FROM (SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 9000 PRECEDING AND CURRENT ROW) AS n FROM (SELECT event_id, event_type, date_trunc('second', ts) AS ts FROM events) WHERE event_type = 'error')")
def t5(t: Tables):
    return J.trailing_failures(t.events.where("event_type = 'error'"), "ts", "event_type", 9000).select("event_id", "failures", "cooldown")


@query("t6_transition_dedup", "SELECT DISTINCT event_type || '/' || user_id || '/' || ts::DATE AS key FROM events WHERE event_type IN ('click', 'purchase')")
def t6(t: Tables):
    rows = _stream(t).withColumn("key", F.concat_ws("/", "event_type", c("user_id").cast("string"), F.to_date("ts").cast("string")))
    return J.drain(J.distinct_transitions(rows, "ts", "key", ["click", "purchase"], "event_type", "40 days").select("key"), "transitions")


@query(
    "t7_demand_state",
    """SELECT user_id, CASE WHEN status IS NULL OR (status IN ('failed', 'published', 'unresolved') AND asked > tm) THEN 'queued' ELSE status END AS status, priority, demand_count, asked AS last_seen_at
    FROM (SELECT user_id, arg_max(s, (ts, s)) FILTER (WHERE s IS NOT NULL) AS status, max(ts) FILTER (WHERE s IS NOT NULL) AS tm, max(ts) FILTER (WHERE s IS NULL) AS asked, max(floor(value)::BIGINT) FILTER (WHERE s IS NULL) AS priority, count(*) FILTER (WHERE s IS NULL) AS demand_count
      FROM (SELECT *, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'published' WHEN 'signup' THEN 'researching' END AS s FROM events) GROUP BY 1) WHERE demand_count > 0""",
)
def t7(t: Tables):
    """Events as requests and transitions of a user's demand, in four batches."""
    e = c("event_type")
    status = F.when(e == "error", "failed").when(e == "purchase", "published").when(e == "signup", "researching")
    rows = _event_files(t, "user_id", "event_type", "value").withColumn("p", F.floor("value")).withColumn("s", status)
    out = J.drain(J.demand_state(rows, "user_id", "ts", "p", "s"), "demand", "update")
    last = out.groupBy("user_id").agg(F.max_by(F.struct("status", "priority", "demand_count", "last_seen_at"), "batch").alias("d"))
    return last.select("user_id", "d.status", "d.priority", "d.demand_count", c("d.last_seen_at").cast("timestamp_ntz").alias("last_seen_at"))


@query("t8_lease_timeouts")
def t8(t: Tables):
    return J.drain(J.lease_timeouts(_stream(t), "user_id", "ts", 60), "leases")


@query("t9_ttl", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY AND ts + INTERVAL 20 DAY > TIMESTAMP '2024-01-31'")
def t9(t: Tables):
    rows = t.events.withColumn("expires_at", c("ts") + F.expr("interval 20 days"))
    return S.retained(rows, "ts", F.lit("2024-01-31").cast("timestamp_ntz"), 30, "expires_at").select("event_id")


@query(
    "t9_idle_keys",
    """WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS tm FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY tm) AS g FROM (SELECT *, (tm >= coalesce(lag(tm) OVER (PARTITION BY user_id ORDER BY tm), 0) + 86400000)::INT AS new FROM e))
    SELECT user_id, make_timestamp(min(tm) * 1000) AS opened_at, make_timestamp((max(tm) + 86400000) * 1000) AS closed_at, count(*) AS n, 'waited' AS reason FROM s GROUP BY user_id, g HAVING max(tm) + 86400000 <= (SELECT max(tm) - 1000 FROM e) OR g < (SELECT max(z.g) FROM s z WHERE z.user_id = s.user_id)""",
)
def t9_idle(t: Tables):
    """Users whose state is dropped a day after their last event."""
    out = J.drain(J.idle_keys(_event_files(t, "user_id"), "user_id", "ts", 86_400), "idle")
    return out.withColumns({x: c(x).cast("timestamp_ntz") for x in ("opened_at", "closed_at")})


@query("t10_hourly_outcomes", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def t10(t: Tables):
    out = J.drain(J.hourly_outcomes(_stream(t), "ts", "event_type", "40 days"), "hours", "update")
    last = out.groupBy("hour", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return last.withColumn("hour", c("hour").cast("timestamp_ntz"))
