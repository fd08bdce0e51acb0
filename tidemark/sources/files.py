"""Typed scans and sinks (inventory S)."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/tidemark-{label}-{uuid.uuid4().hex}"


def typed_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a declared schema; the first bad record fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def export_json(df: DataFrame, path: str, counted: Sequence[str]) -> DataFrame:
    """Writes JSON lines and returns the manifest, counted on what was written: (column, value, n)."""
    df.write.json(path)
    back = df.sparkSession.read.schema(df.schema).json(path)
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("(missing)")).alias("value")) for c in counted))
    return back.select(F.explode(each).alias("d")).groupBy("d.column", "d.value").agg(F.count("*").alias("n"))


def landing(spark: SparkSession, path: str, keep_content: bool = False) -> DataFrame:
    """S3: files as (path, media_type, text), with ``content`` if wanted; other media types have a null text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.when(F.col("path").rlike(r"(?i)\.html?$"), "text/html").when(F.col("path").rlike(r"(?i)\.(txt|md|log)$"), "text/plain").otherwise("application/octet-stream")
    raw = raw.where(~F.col("path").rlike(r"/[_.][^/]*$"))
    return raw.select("path", kind.alias("media_type"), F.when(kind.startswith("text/"), F.col("content").cast("string")).alias("text"), *(["content"] if keep_content else []))


def renamed(spark: SparkSession, path: str, ending: str) -> None:
    """Gives the part files of a written folder another ending."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder = fs_path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("part-"):
            fs.rename(status.getPath(), fs_path(folder, name.rpartition(".")[0] + ending))


def feed_page(events: DataFrame, key: str, after: int, limit: int) -> DataFrame:
    """The next ``limit`` events after a cursor, with ``has_more``; one row more is read to know it."""
    rows = events.where(F.col(key) > after).orderBy(key).limit(limit + 1)
    more = rows.agg((F.count("*") > limit).alias("has_more"))
    return rows.orderBy(key).limit(limit).join(F.broadcast(more))


def bound_reports(reports: DataFrame, active: DataFrame, stored: DataFrame, commit: str) -> DataFrame:
    """New validation reports (stable_key, commit, content_hash, checks, passed) of the wanted commit with all
    checks passed, bound to the active revision of the same content hash; already stored ones are left out."""
    good = reports.where((F.col("commit") == commit) & (F.col("checks") == F.col("passed")))
    bound = good.join(active, ["stable_key", "content_hash"])
    return bound.join(stored.select("revision_id", "commit"), ["revision_id", "commit"], "left_anti")


def refresh_snapshot(old: DataFrame | None, new: DataFrame, as_of: Column, release: Column, minutes: int = 5) -> DataFrame:
    """The old one-row snapshot (with ``taken_at`` and ``release_id``) while it is fresh and of the same release, else the new one."""
    fresh = new.withColumn("taken_at", as_of).withColumn("release_id", release)
    if old is None:
        return fresh
    keep = (F.col("taken_at") > as_of - F.expr(f"interval {minutes} minutes")) & F.col("release_id").eqNullSafe(release)
    kept = old.where(keep)
    none = kept.agg((F.count("*") == 0).alias("_none"))
    return kept.unionByName(fresh.join(F.broadcast(none)).where("_none").drop("_none"))


def stale(taken_at: Column, failed: Column, as_of: Column, minutes: int = 10) -> Column:
    """Older than ``minutes``, or the last refresh failed."""
    return failed | (taken_at < as_of - F.expr(f"interval {minutes} minutes"))


def inline_records(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON array of records as typed rows."""
    return df.select(*(c for c in df.columns if c != column), F.inline(F.from_json(column, f"array<struct<{schema}>>")))


def contributions(samples: DataFrame, stored: DataFrame, text: Column) -> DataFrame:
    """(content_hash, sample, expires_at) after new samples: redacted text, one row a hash, latest expiry."""
    new = samples.select(F.sha2(text, 256).alias("content_hash"), text.alias("sample"), "expires_at")
    return stored.unionByName(new).groupBy("content_hash").agg(F.min("sample").alias("sample"), F.max("expires_at").alias("expires_at"))


def retained(df: DataFrame, at: str, as_of: Column, days: int, expires: str | None = None) -> DataFrame:
    """Rows younger than ``days`` and not expired."""
    keep = F.col(at) >= as_of - F.expr(f"interval {days} days")
    return df.where(keep & (F.col(expires).isNull() | (F.col(expires) > as_of)) if expires else keep)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], options: Mapping[str, str] | None = None) -> None:
    """A partitioned Parquet table, each partition's rows from few tasks."""
    df.repartition(*by).write.options(**(options or {})).partitionBy(*by).parquet(path)
