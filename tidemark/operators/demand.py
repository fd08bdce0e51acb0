"""Unanswered questions as prioritised demand (inventory M)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T

# Public learning status by demand status.
LEARNING = {"diagnosing": "diagnosing", "queued": "discovering", "discovering": "discovering", "acquiring": "processing", "processing": "processing", "published": "rechecking"}


def outcome(response: Column) -> Column:
    """M1: unknown, blocked or success, from a response as JSON."""
    get = lambda k: F.get_json_object(response, f"$.{k}")
    unknown = get("answer_status").isin("partial", "unknown") | (get("unknown") == "true") | (get("status") == "unknown") | (get("decision") == "unknown")
    return F.when(F.coalesce(unknown, F.lit(False)), "unknown").when(get("decision") == "blocked", "blocked").otherwise("success")


def question(payload: Column, tool: Column) -> Column:
    """M2: the first of question, goal and intent, else a preview; at most 1,000 characters."""
    keys = [F.get_json_object(payload, f"$.{k}") for k in ("question", "goal", "intent")]
    preview = F.concat(F.lit('{"tool":"'), tool, F.lit('","input":'), F.coalesce(payload, F.lit("null")), F.lit("}"))
    return F.substring(F.coalesce(*keys, preview), 1, 1000)


def demand_key(text: Column, context: Column) -> Column:
    """M3: a hash of the lower-case question and the sorted context map."""
    entries = F.array_sort(F.map_entries(context))
    return F.sha2(F.to_json(F.struct(F.map_from_entries(entries).alias("context"), F.lower(T.trimmed(text)).alias("question"))), 256)


def upserted(old: DataFrame, requests: DataFrame) -> DataFrame:
    """M4: demands (demand_key, status, priority, demand_count, last_seen_at) after requests (demand_key,
    priority, occurred_at): counts add up, priority is the largest, and a failed or published demand is queued again."""
    new = requests.groupBy("demand_key").agg(F.count("*").alias("_n"), F.max("priority").alias("_p"), F.max("occurred_at").alias("_at"))
    out = old.join(new, "demand_key", "full")
    again = F.col("_n").isNotNull() & (F.col("status").isNull() | F.col("status").isin("failed", "published", "unresolved"))
    return out.select(
        "demand_key",
        F.when(again, "queued").otherwise(F.col("status")).alias("status"),
        F.greatest("priority", "_p").alias("priority"),
        (F.coalesce("demand_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("demand_count"),
        F.greatest("last_seen_at", "_at").alias("last_seen_at"),
    )


def coverage_targets(demands: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """M5: targets that demands ask for and that don't exist; null key parts are equal."""
    want = demands.groupBy(*keys).agg(F.max("priority").alias("priority"))
    have = targets.select(*keys).distinct().alias("h")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"w.{k}").eqNullSafe(F.col(f"h.{k}"))
    return want.alias("w").join(have, on, "left_anti")


def gap_priority(priority: Column, cap: int = 40) -> Column:
    """M6: a gap in specificity ranks below any unanswered question."""
    return F.least(priority, F.lit(cap))


def topic_key(family: Column, portable: Column, vendor: Column, capabilities: Column) -> Column:
    """M7: a hash of the family (with the vendor, unless portable) and the sorted distinct capabilities."""
    names = F.array_join(F.array_sort(F.array_distinct(capabilities)), ",")
    return F.sha2(F.concat_ws("|", F.when(portable, F.lit("portable")).otherwise(vendor), family, names), 256)


def topic_rollup(topics: DataFrame, demands: DataFrame) -> DataFrame:
    """M8: topics (topic_id, priority_score) with request and unique demand counts and a priority of at least
    1 + ln(1 + requests), at most 1000. ``demands`` is (topic_id, demand_id, demand_count)."""
    n = demands.groupBy("topic_id").agg(F.sum("demand_count").alias("request_count"), F.countDistinct("demand_id").alias("unique_demand_count"))
    out = topics.join(n, "topic_id", "left")
    score = F.least(F.lit(1000.0), F.greatest(F.col("priority_score"), 1 + F.log1p(F.coalesce("request_count", F.lit(0)).cast("double"))))
    return out.select("topic_id", F.coalesce("request_count", F.lit(0)).alias("request_count"), F.coalesce("unique_demand_count", F.lit(0)).alias("unique_demand_count"), score.alias("priority_score"))


def repeat_priority(requests: Column) -> Column:
    """M8: the priority of a repeated hit, 1 + ln(2 + requests)."""
    return 1 + F.log(2 + requests.cast("double"))


def cooled(topics: DataFrame, attempts: DataFrame, limit: int = 3, decay: float = 0.8) -> DataFrame:
    """M9: topics with ``limit`` fruitless attempts are exhausted, with fewer they cool down; priority decays."""
    n = attempts.groupBy("topic_id").agg(F.count_if(F.col("found") == 0).alias("fruitless"))
    out = topics.join(n, "topic_id", "left").withColumn("fruitless", F.coalesce("fruitless", F.lit(0)))
    state = F.when(F.col("fruitless") >= limit, "exhausted").when(F.col("fruitless") > 0, "cooldown").otherwise("active")
    return out.select("topic_id", state.alias("state"), F.when(F.col("fruitless") > 0, F.col("priority_score") * decay).otherwise(F.col("priority_score")).alias("priority_score"))


def replayed(demands: DataFrame, coverage: DataFrame) -> DataFrame:
    """Open demands whose question is now completely covered become published."""
    done = coverage.where("status = 'complete'").select(F.col("question_id").alias("demand_id"), F.lit(True).alias("_done"))
    out = demands.join(done, "demand_id", "left")
    return out.withColumn("status", F.when(F.col("_done") & (F.col("status") != "published"), "published").otherwise(F.col("status"))).drop("_done")


def resolved_topics(topics: DataFrame, members: DataFrame) -> DataFrame:
    """Topics with members, all of them published."""
    done = members.groupBy("topic_id").agg(F.bool_and(F.col("status") == "published").alias("all"))
    return topics.join(done.where("all"), "topic_id", "left_semi")


#: Finished sources up to which their places are broadcast, and four times the blocks of them; more are joined.
FEW_SOURCES = 500_000


#: Pairs that a task makes, about.
DEALT = 10_000_000


def reusable(sources: DataFrame, demands: DataFrame, ledger: DataFrame, on: str, by: str = "demand_id") -> DataFrame:
    """(demand_id, source_id): finished sources of a demand's target not tried for it at their content hash.

    The finished sources of a target have places, 64 to a block, and what a demand has tried is a bit in the block's number, so that no
    single pair is shuffled: only blocks are, and pairs are made from them last. Demands that have tried the same sources can share a
    value ``by`` which the ledger has in place of their ids; what is left of a block is then found once for all of them, and demands alone are shuffled,
    into as many tasks as their pairs ask for.
    """
    live = sources.where("status in ('completed', 'completed_with_exceptions')").select(on, "source_id", "content_hash")
    n = F.row_number().over(W.partitionBy(on).orderBy("source_id", "content_hash")) - 1
    placed = live.withColumn("_n", n).select(on, "source_id", "content_hash", F.floor(F.col("_n") / 64).cast("int").alias("_block"), (F.col("_n") % 64).cast("int").alias("_bit"))
    few = F.broadcast if live.count() <= FEW_SOURCES else (lambda df: df)
    bits = F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_tried")
    tried = ledger.select(by, "source_id", "content_hash").join(few(placed), ["source_id", "content_hash"]).groupBy(by, on, "_block").agg(bits)
    offered = placed.groupBy(on, "_block").agg(F.array_sort(F.collect_list(F.struct("_bit", "source_id"))).alias("_sources"))
    free = "coalesce(_tried, 0L) & shiftleft(1L, {}) = 0"
    if by == "demand_id":
        each = demands.select("demand_id", on).join(few(offered.select(on, "_block")), on).join(tried, ["demand_id", on, "_block"], "left")
        pairs = each.join(few(offered), [on, "_block"]).select("demand_id", "_tried", F.inline("_sources"))
        return pairs.where(F.expr(free.format("_bit"))).select("demand_id", "source_id")
    each = demands.select(by, on).distinct().join(few(offered), on).join(tried, [by, on, "_block"], "left")
    left = each.select(F.col(by).alias("_by"), F.col(on).alias("_on"), F.expr(f"transform(filter(_sources, s -> {free.format('s._bit')}), s -> s.source_id)").alias("_left"))
    many = demands.groupBy(on).count().join(live.groupBy(on).agg(F.count("*").alias("_n")), on).agg(F.sum(F.col("count") * F.col("_n"))).first()[0] or 0
    dealt = demands.select("demand_id", by, on).repartition(min(100_000, many // DEALT + 1), "demand_id")
    same = F.col(by).eqNullSafe(F.col("_by")) & (F.col(on) == F.col("_on"))
    few = F.broadcast if left.count() <= FEW_SOURCES // 4 else (lambda df: df)
    return dealt.join(few(left), same).select("demand_id", F.explode("_left").alias("source_id"))


def exhausted(demands: DataFrame, sources: DataFrame, terminal: Sequence[str]) -> DataFrame:
    """Demands with sources, all terminal and none of use, with a reason."""
    s = sources.groupBy("demand_id").agg(F.bool_and(F.col("status").isin(list(terminal))).alias("_all"), F.bool_or(F.col("status") == "completed").alias("_any"))
    return demands.join(s, "demand_id").where(F.col("_all") & ~F.col("_any")).select("demand_id", F.lit("unresolved").alias("status"), F.lit("SOURCES_EXHAUSTED").alias("reason"))


def next_demands(demands: DataFrame, n: int) -> DataFrame:
    """The next demands: the topic served longest ago (never first), then score, priority, age."""
    return demands.orderBy(F.asc_nulls_first("last_served_at"), F.desc_nulls_last("priority_score"), F.desc("priority"), "created_at", "demand_id").limit(n)


def is_gap(assurance: Column, level: Column, confirm: Column) -> Column:
    """An approximate first answer; portable family answers that need no confirmation are none."""
    portable = (assurance == "generic") & (level == "os_family") & ~F.coalesce(confirm, F.lit(True))
    return F.coalesce(assurance.isin("generic", "best_effort") & ~portable, F.lit(False))


def learning_status(status: Column) -> Column:
    """M16."""
    table = F.create_map(*(F.lit(x) for kv in LEARNING.items() for x in kv))
    return F.coalesce(table[status], F.lit("unavailable"))


def recovered(demands: DataFrame, candidates: DataFrame, technical: Sequence[str]) -> DataFrame:
    """Failed demands with a technical error code and a live candidate."""
    return demands.where((F.col("status") == "failed") & F.col("error_code").isin(list(technical))).join(candidates.select("demand_id"), "demand_id", "left_semi")
