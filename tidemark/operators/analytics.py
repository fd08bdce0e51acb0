"""Operational analytics over logs, tasks and runs (inventory A). Every clock is ``as_of``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import best_per_key, dense_series, distinct_where, nearest_rank, ratio


def public_stats(log: DataFrame, coverage: DataFrame, evaluations: DataFrame, outcome: str, model_calls: Column) -> DataFrame:
    """A1: one row: usage totals, share answered without a model, coverage counts, latest evaluation."""
    use = log.agg(F.count("*").alias("requests"), F.count_if(F.col(outcome) == "success").alias("answered"), ratio(F.count_if(model_calls == 0), F.count("*")).alias("no_model_rate"))
    cover = coverage.agg(F.countDistinct("vendor").alias("vendors"), F.countDistinct("vendor", "platform").alias("platforms"))
    last = evaluations.agg(F.max_by(F.struct("passed", "total"), "at").alias("e")).select(F.col("e.passed").alias("passed"), F.col("e.total").alias("total"))
    return use.join(F.broadcast(cover)).join(F.broadcast(last))


def daily_series(tables: Mapping[str, tuple[DataFrame, str, Column]], start: str, end: str, unit: str = "day") -> DataFrame:
    """A2, A4, A5: a dense series with a column for each table: (frame, time column, aggregate)."""
    out = None
    for name, (df, at, agg) in tables.items():
        one = df.groupBy(F.date_trunc(unit, F.col(at)).alias("bucket")).agg(agg.alias(name))
        out = one if out is None else out.join(one, "bucket", "full")
    return dense_series(out, start, end, unit, "bucket")


def request_analytics(log: DataFrame, at: str, kind: str, kinds: Sequence[str], start: str, end: str) -> DataFrame:
    """A3: a dense hourly series with a count for each kind."""
    by = log.groupBy(F.date_trunc("hour", F.col(at)).alias("bucket")).agg(F.count("*").alias("total"), *(F.count_if(F.col(kind) == k).alias(k) for k in kinds))
    return dense_series(by, start, end, "hour", "bucket")


def overview(df: DataFrame, counters: Mapping[str, Column], ratios: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Conditional counters in one pass, and ratios between them."""
    out = df.agg(*(c.alias(n) for n, c in counters.items()))
    return out.select("*", *(ratio(F.col(a), F.col(b)).alias(n) for n, (a, b) in ratios.items()))


def funnel(tasks: DataFrame, stages: Sequence[str], stage: str, status: str, created: str, owner: str, live: Column) -> DataFrame:
    """For every stage in order the counts by status, the oldest waiting task, and live owners."""
    rows = tasks.sparkSession.range(1).select(F.posexplode(F.array(*(F.lit(s) for s in stages))).alias("ordinal", "stage"))
    waiting = F.col(status).isin("queued", "retry")
    counts = tasks.groupBy(F.col(stage).alias("stage")).agg(
        F.count_if(waiting).alias("waiting"),
        F.min(F.when(waiting, F.col(created))).alias("oldest_waiting_at"),
        *(F.count_if(F.col(status) == s).alias(s) for s in ("running", "completed", "failed")),
        distinct_where(owner, live).alias("owners"),
    )
    out = rows.join(counts, "stage", "left")
    return out.select("ordinal", "stage", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("waiting", "running", "completed", "failed")), "oldest_waiting_at", F.coalesce("owners", F.expr("cast(array() as array<string>)")).alias("owners"))


def liveness(workers: DataFrame, beats: DataFrame, as_of: Column, stale_minutes: int = 2) -> DataFrame:
    """Running, stale, paused or standby by the age of the last heartbeat. ``workers`` is (owner, paused)."""
    last = beats.groupBy("owner").agg(F.max("at").alias("heartbeat_at"))
    out = workers.join(last, "owner", "left")
    state = F.when(F.col("paused"), "paused").when(F.col("heartbeat_at").isNull(), "standby").when(F.col("heartbeat_at") < as_of - F.expr(f"interval {stale_minutes} minutes"), "stale").otherwise("running")
    return out.select("owner", "heartbeat_at", state.alias("state"))


def with_progress(df: DataFrame, parts: DataFrame, key: str, done: Column) -> DataFrame:
    """Parts, finished parts and percent of every row."""
    n = parts.groupBy(key).agg(F.count("*").alias("parts"), F.count_if(done).alias("done"))
    out = df.join(n, key, "left").withColumn("parts", F.coalesce("parts", F.lit(0))).withColumn("done", F.coalesce("done", F.lit(0)))
    return out.withColumn("percent", F.round(F.coalesce(F.try_divide(F.col("done") * 100.0, F.col("parts")), F.lit(0.0)), 1))


def exceptions(candidates: DataFrame, key: str, severity: Column, n: int) -> DataFrame:
    """The first ``n`` rows by severity, then key."""
    return candidates.withColumn("severity", severity).orderBy("severity", key).limit(n)


def run_costs(runs: DataFrame, key: str, tokens: Column, published: Column) -> DataFrame:
    """Tokens for each published revision by run; null where a run published none."""
    return runs.groupBy(key).agg(F.sum(tokens).alias("tokens"), F.sum(published).alias("published")).withColumn("tokens_per_revision", ratio(F.col("tokens"), F.col("published"), 2))


def quality_dashboard(df: DataFrame, by: str, value: str, thresholds: Mapping[str, float]) -> DataFrame:
    """Rounded average and counts over thresholds by group."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(value), 2).alias("mean"), *(F.count_if(F.col(value) >= t).alias(k) for k, t in thresholds.items()))


def latest_event(tasks: DataFrame, events: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Tasks with their latest event's columns."""
    best = events.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_m"))
    return tasks.join(best, key, "left").select(*tasks.columns, *(F.col(f"_m.{c}").alias(c) for c in columns))


def evaluation(cases: DataFrame, results: DataFrame, dangerous: Column) -> DataFrame:
    """By case type passed, failed, false-safe counts and nearest-rank latency. ``cases`` is (case_id, type,
    expected), ``results`` (case_id, got, latency); a case without a result fails."""
    both = cases.join(results, "case_id", "left").withColumn("_ok", F.coalesce(F.col("got") == F.col("expected"), F.lit(False)))
    counts = both.groupBy("type").agg(F.count_if(F.col("_ok")).alias("passed"), F.countDistinct(F.when(~F.col("_ok"), F.col("case_id"))).alias("failed"), F.count_if(~F.col("_ok") & dangerous).alias("false_safe"))
    return counts.join(nearest_rank(both, ["type"], "latency", {"p50": 0.5, "p95": 0.95}).drop("n"), "type", "left")


def orphaned(runs: DataFrame, live: DataFrame, key: str, started: str, as_of: Column, minutes: int = 15) -> DataFrame:
    """Runs older than ``minutes`` without a live task."""
    return runs.where(F.col(started) < as_of - F.expr(f"interval {minutes} minutes")).join(live.select(key), key, "left_anti")


def load_by_class(work: DataFrame, open_circuits: DataFrame, cls: Column) -> DataFrame:
    """Work by class, without the classes whose circuit is open."""
    return work.withColumn("class", cls).join(open_circuits.select("class"), "class", "left_anti").groupBy("class").agg(F.count("*").alias("n"))


def due(targets: DataFrame, as_of: Column, n: int) -> DataFrame:
    """Targets (target_id, paused, status, next_check_at, priority, created_at) that are due, first ones."""
    ready = ~F.col("paused") & (F.col("status").isin("queued", "failed") | (F.col("next_check_at") <= as_of))
    return targets.where(ready).orderBy(F.desc("priority"), "created_at", "target_id").limit(n)


def coverage_page(targets: DataFrame, percent: str, is_due: Column, key: str, n: int = 20) -> tuple[DataFrame, DataFrame]:
    """(average and due count, the lowest ``n``)."""
    return targets.agg(F.round(F.avg(percent), 2).alias("average"), F.count_if(is_due).alias("due")), targets.orderBy(percent, key).limit(n)


def bottlenecks(stages: DataFrame, flow: str) -> DataFrame:
    """By flow the stage whose waiting item is oldest."""
    return best_per_key(stages.where("oldest_waiting_at is not null"), [flow], [F.col("oldest_waiting_at"), F.col("stage")]).select(flow, "stage", "oldest_waiting_at")
