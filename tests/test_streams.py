"""Streams over several files: state across batches, late rows, restarts."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.releases import ReleaseLog
from tidemark.sources.files import shared_path
from tidemark.streaming import jobs as J

START = datetime(2024, 1, 1, 10)
SCHEMA = "id long, ts timestamp, kind string, key string, p double"


def put(spark, path, rows):
    """One file of (id, minutes after the start, kind, key, p)."""
    data = [(i, START + timedelta(minutes=m), k, x, float(p)) for i, m, k, x, p in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def folder(spark):
    path = shared_path(spark, "stream-test")
    put(spark, path, [(1, 0, "error", "a", 3), (2, 1, "view", "b", 1), (3, 2, "error", "a", 2)])
    put(spark, path, [(4, 5, "error", "a", 9), (5, 6, "error", "b", 1)])
    put(spark, path, [(6, 180, "view", "a", 4)])
    return path


def stream(spark, path):
    return J.file_stream(spark, path, 1)


def test_ingest_resumes_after_a_restart(spark, folder):
    out = shared_path(spark, "ingest-test")
    ingest = lambda: J.ingest(stream(spark, folder), lambda b: b.select("id", "kind"), f"{out}/rows", f"{out}/check").awaitTermination()
    ingest()
    rows = lambda: sorted(r["id"] for r in spark.read.parquet(f"{out}/rows/*").collect())
    assert rows() == [1, 2, 3, 4, 5, 6]
    ingest()  # nothing new
    put(spark, folder, [(7, 200, "view", "c", 1)])
    ingest()
    assert rows() == [1, 2, 3, 4, 5, 6, 7]


def test_a_replayed_batch_replaces_its_rows(spark, folder):
    out = shared_path(spark, "replay-test")

    def fails_once(batch):
        if not spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/failed").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/failed")):
            raise AssertionError
        if not failed:
            failed.append(1)
            batch.write.mode("overwrite").parquet(f"{out}/rows/batch_no=0")  # half a batch is there when the job dies
            raise RuntimeError("lost")
        return batch

    failed = []
    with pytest.raises(Exception, match="lost"):
        J.ingest(stream(spark, folder), fails_once, f"{out}/rows", f"{out}/check").awaitTermination()
    J.ingest(stream(spark, folder), fails_once, f"{out}/rows", f"{out}/check").awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{out}/rows/*").collect()) == [1, 2, 3, 4, 5, 6]


def test_late_rows_are_dropped_and_others_counted_once(spark, folder):
    put(spark, folder, [(9, 186, "view", "c", 1)])
    put(spark, folder, [(7, 3, "error", "a", 1), (8, 185, "error", "a", 1)])  # the first is hours behind the watermark
    out = J.drain(J.rate_counts(stream(spark, folder), "ts", ["key"], "10 minutes", 2), "rates-test")
    got = {(r["start"], r["key"]): (r["n"], r["limited"], r["remaining"]) for r in out.collect()}
    at = lambda m: START + timedelta(minutes=m)
    assert got[at(0), "a"] == (3, True, 0) and got[at(0), "b"] == (2, False, 0)
    latest = J.drain(J.rate_counts(stream(spark, folder), "ts", ["key"], "10 minutes", 2, "30 days"), "rates-test", "update")
    last = {(r["start"], r["key"]): r["n"] for r in latest.orderBy("batch").collect()}
    assert last[at(0), "a"] == 4 and last[at(180), "a"] == 2


def test_sliding_failures_equal_the_batch_form(spark, folder):
    errors = stream(spark, folder).where("kind = 'error'")
    got = J.drain(J.sliding_failures(errors, "ts", "key", "30 days"), "sliding-test", "update")
    got = got.groupBy("end", "key").agg(F.max_by("failures", "batch").alias("failures"))
    want = J.sliding_failures(spark.read.parquet(folder).where("kind = 'error'"), "ts", "key").select("end", "key", "failures")
    rows = lambda df: sorted((r["end"], r["key"], r["failures"]) for r in df.collect())
    assert rows(got) == rows(want) and max(r[2] for r in rows(want)) == 3


def test_transitions_once_across_files(spark, folder):
    put(spark, folder, [(9, 181, "error", "a", 1), (10, 182, "open", "z", 1)])
    out = J.drain(J.distinct_transitions(stream(spark, folder), "ts", "key", ["error", "view"], "kind", "1 day").select("key"), "once-test")
    assert sorted(r["key"] for r in out.collect()) == ["a", "b"]


def test_demand_state_goes_on_after_a_restart(spark, folder):
    """M4 in the state: errors fail a demand, views ask for it; the last file comes late but is older."""
    out = shared_path(spark, "demand-test")

    def go():
        rows = stream(spark, folder).withColumn("s", F.when(F.col("kind") == "error", "failed").when(F.col("kind") == "work", "researching"))
        return J.drain(J.demand_state(rows, "key", "ts", "p", "s"), "demand-test", "update", out)

    go()
    put(spark, folder, [(11, 300, "error", "a", 1), (12, 301, "view", "c", 7)])
    put(spark, folder, [(13, 302, "work", "c", 1), (14, 303, "view", "c", 2)])
    put(spark, folder, [(15, 4, "view", "b", 9)])
    last = {r["key"]: (r["status"], r["priority"], r["demand_count"], r["last_seen_at"]) for r in go().orderBy("batch").collect()}
    at = lambda m: START + timedelta(minutes=m)
    # a asked at 180 and failed after it; b failed at 6, after both requests; c goes on being researched
    assert last == {"a": ("failed", 4, 1, at(180)), "b": ("failed", 9, 2, at(4)), "c": ("researching", 7, 2, at(303))}


def test_groups_close_full_or_by_timer(spark, folder):
    put(spark, folder, [(9, 400, "view", "z", 1)])
    out = J.drain(J.ready_groups(stream(spark, folder), "key", "ts", 2, 60 * 60), "ready-test")
    at = lambda m: START + timedelta(minutes=m)
    got = sorted((r["key"], r["opened_at"], r["closed_at"], r["n"], r["reason"]) for r in out.collect())
    # a: two at once, the third waits its hour, as does the fourth; b: full
    assert got == [("a", at(0), at(2), 2, "full"), ("a", at(5), at(65), 1, "waited"), ("a", at(180), at(240), 1, "waited"), ("b", at(1), at(6), 2, "full")]


def test_idle_keys_are_dropped_and_begin_anew(spark, folder):
    put(spark, folder, [(9, 400, "view", "z", 1)])
    out = J.drain(J.idle_keys(stream(spark, folder), "key", "ts", 60 * 60), "idle-test")
    at = lambda m: START + timedelta(minutes=m)
    got = sorted((r["key"], r["opened_at"], r["closed_at"], r["n"]) for r in out.collect())
    assert got == [("a", at(0), at(65), 3), ("a", at(180), at(240), 1), ("b", at(1), at(66), 2)]


def test_ingest_that_dies_publishes_each_release_once(spark, folder):
    """It dies after the gate, then after the delta but before the ledger; the releases are those of an undisturbed run."""
    steps = lambda b: b.groupBy(F.col("key").alias("item_id")).agg(F.max("id").cast("string").alias("revision_id"))

    class Dying(ReleaseLog):
        left = ["gate", "delta", "ledger"]

        def publish(self, release, batch):
            if release == 1 and self.left:
                where = self.left.pop(0)
                if where == "gate":
                    raise RuntimeError("lost at the gate")
                if where == "delta":  # a delta of another attempt is there, without its ledger row
                    self.spark.createDataFrame([("x", None, "wrong")], "item_id string, previous_revision_id string, new_revision_id string").write.parquet(f"{self.path}/delta/release=1")
                    raise RuntimeError("lost after the delta")
                super().publish(release, batch)
                raise RuntimeError("lost after the ledger")
            super().publish(release, batch)

    path = shared_path(spark, "dying")
    log = Dying(spark, f"{path}/log", 2)
    for where in ("gate", "delta", "ledger"):
        with pytest.raises(Exception, match="lost"):
            J.ingest_releases(stream(spark, folder), steps, log, f"{path}/check").awaitTermination()
        assert log.ledger().count() == (2 if where == "ledger" else 1)
    J.ingest_releases(stream(spark, folder), steps, log, f"{path}/check").awaitTermination()
    got = sorted((r["release"], r["item_id"], r["previous_revision_id"], r["new_revision_id"]) for r in log.changes().collect())
    assert got == [(0, "a", None, "3"), (0, "b", None, "2"), (1, "a", "3", "4"), (1, "b", "2", "5"), (2, "a", "4", "6")]
    assert {r["release"]: r["mode"] for r in log.ledger().collect()} == {0: "full", 1: "full", 2: "delta"}


def test_a_stored_log_reads_only_what_it_needs(spark):
    log = ReleaseLog(spark, shared_path(spark, "log-test"), 3)
    batch = lambda *rows: spark.createDataFrame(rows, "item_id string, revision_id string")
    want, state = {}, {}
    for release in range(8):
        rows = [("a", f"a{release}"), ("b", "b0"), ("c", None if release % 4 == 2 else f"c{release // 2}")]
        log.publish(release, batch(*rows))
        state = {k: v for k, v in (state | dict(rows)).items() if v}
        want[release] = state
    for release in range(8):
        df = log.state(release)
        assert {r["item_id"]: r["revision_id"] for r in df.collect()} == want[release]
    assert log.line(7) == ([5], [6, 7])
    folders = {f.rsplit("/", 3)[1] + "/" + f.rsplit("/", 2)[1] for f in log.state(7).inputFiles()}
    assert folders == {"full/release=5", "delta/release=6", "delta/release=7"}
    assert log.state(-1).count() == 0


def test_leases_expire_by_event_time(spark, folder):
    put(spark, folder, [(13, 400, "view", "z", 1)])
    put(spark, folder, [(14, 401, "view", "z", 1)])
    out = J.drain(J.lease_timeouts(stream(spark, folder), "key", "ts", 60), "lease-test").collect()
    ms = lambda m: int((START - datetime(1970, 1, 1)).total_seconds() * 1000) + m * 60_000
    got = sorted((r["key"], r["expired_at"], r["attempts"], r["status"]) for r in out)
    # b is silent from minute 6; a comes back at 180, before the watermark passes its first hour, and is silent from then
    assert got == [("a", ms(240), 1, "retry"), ("b", ms(66), 1, "retry")]


def test_hourly_outcomes_over_batches(spark, folder):
    out = J.drain(J.hourly_outcomes(stream(spark, folder), "ts", "kind", "30 days"), "hours-test", "update")
    last = {(r["hour"].hour, r["kind"]): r["n"] for r in out.orderBy("batch").collect()}
    assert last == {(10, "error"): 4, (10, "view"): 1, (13, "view"): 1}
