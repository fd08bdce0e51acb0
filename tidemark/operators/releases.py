"""Releases as deltas and checkpoints, replay, provenance, audits (inventory R)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .relational import best_per_key, closure


def delta(state: DataFrame, batch: DataFrame) -> DataFrame:
    """(item_id, previous_revision_id, new_revision_id) of items whose revision changes.
    ``state`` and ``batch`` are (item_id, revision_id), one row an item."""
    b = batch.withColumnRenamed("revision_id", "new_revision_id")
    out = b.join(state.withColumnRenamed("revision_id", "previous_revision_id"), "item_id", "left")
    return out.where(~F.col("previous_revision_id").eqNullSafe(F.col("new_revision_id"))).select("item_id", "previous_revision_id", "new_revision_id")


def merged(state: DataFrame, changes: DataFrame) -> DataFrame:
    """R2: the state after changes; a null new revision removes the item."""
    new = changes.select("item_id", F.col("new_revision_id").alias("_new"), F.lit(True).alias("_changed"))
    out = state.join(new, "item_id", "full")
    return out.select("item_id", F.when(F.col("_changed"), F.col("_new")).otherwise(F.col("revision_id")).alias("revision_id")).where("revision_id is not null")


def is_checkpoint(sequence: Column, every: int = 120) -> Column:
    """The first release and every ``every``-th are written in full."""
    return (sequence == 1) | (sequence % every == 0)


def state_at(releases: DataFrame, full: DataFrame, changes: DataFrame, target: str) -> DataFrame:
    """(item_id, revision_id) at a release: the nearest full one in its ancestry, itself included, and the
    deltas after it, the latest winning. ``releases`` is (release_id, parent_release_id, release_mode), ``full``
    (release_id, item_id, revision_id), ``changes`` (release_id, item_id, new_revision_id)."""
    spark = releases.sparkSession
    root = releases.where(F.col("release_id") == target).select("release_id")
    # no further back than the nearest full release
    written = releases.where("release_mode <> 'delta'").select(F.col("release_id").alias("node"))
    line = closure(spark, releases, root, "release_id", "parent_release_id", written).select(F.col("node").alias("release_id"), "depth")
    modes = line.join(releases.select("release_id", "release_mode"), "release_id")
    base = modes.where("release_mode <> 'delta'").agg(F.min("depth").alias("_base"))  # one row
    near = modes.join(F.broadcast(base)).where(F.col("_base").isNull() | (F.col("depth") <= F.col("_base")))
    start = near.where("depth = _base").join(full, "release_id").select("item_id", "revision_id", "depth")
    later = near.where("_base is null or depth < _base").join(changes, "release_id").select("item_id", F.col("new_revision_id").alias("revision_id"), "depth")
    last = start.unionByName(later).groupBy("item_id").agg(F.min_by(F.struct("revision_id"), "depth").alias("r"))
    return last.select("item_id", "r.revision_id").where("revision_id is not null")


class ReleaseLog:
    """R1 to R4 stored: numbered releases in folders of a shared path. ``delta/release=n`` has the changed items, ``full/release=n`` the
    whole state of the releases that ``is_checkpoint`` picks, ``ledger/release=n`` one row that is written last: a release counts
    from then on. A release that is written again replaces its own folders, so a job that dies anywhere can be run again.

    The ledger has a row a release and is read to the driver; states and deltas are not.
    """

    STATE = "item_id string, revision_id string"

    def __init__(self, spark: SparkSession, path: str, every: int = 120) -> None:
        self.spark, self.path, self.every = spark, path.rstrip("/"), every

    def _exists(self, part: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _read(self, part: str, schema: str, releases: list[int]) -> DataFrame:
        """The folders of these releases only."""
        folders = [f"{self.path}/{part}/release={n}" for n in releases]
        if not folders:
            return self.spark.createDataFrame([], f"{schema}, release int")
        return self.spark.read.schema(f"{schema}, release int").option("basePath", f"{self.path}/{part}").parquet(*folders)

    def ledger(self) -> DataFrame:
        """(release, mode, changed): the releases that count."""
        schema = "mode string, changed long, release int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/ledger") if self._exists("ledger") else self.spark.createDataFrame([], schema)

    def line(self, release: int) -> tuple[list[int], list[int]]:
        """The nearest full release at or before this one, if any, and the releases after it up to this one."""
        rows = sorted((r["release"], r["mode"]) for r in self.ledger().where(F.col("release") <= release).collect())
        base = max((n for n, mode in rows if mode == "full"), default=None)
        return ([] if base is None else [base]), [n for n, _ in rows if base is None or n > base]

    def changes(self, releases: list[int] | None = None) -> DataFrame:
        """(item_id, previous_revision_id, new_revision_id, release) of these releases, else of all that count."""
        numbers = [r["release"] for r in self.ledger().select("release").collect()] if releases is None else releases
        return self._read("delta", "item_id string, previous_revision_id string, new_revision_id string", numbers)

    def state(self, release: int) -> DataFrame:
        """(item_id, revision_id) at a release: the nearest full one and the deltas after it, the latest winning."""
        base, later = self.line(release)
        rows = self._read("full", self.STATE, base).unionByName(self.changes(later).select("item_id", F.col("new_revision_id").alias("revision_id"), "release"))
        last = rows.groupBy("item_id").agg(F.max_by(F.struct("revision_id"), "release").alias("r"))
        return last.select("item_id", "r.revision_id").where("revision_id is not null")

    def publish(self, release: int, batch: DataFrame) -> None:
        """Writes the items of ``batch`` (item_id, revision_id, one row an item; a null revision removes the item) that differ from the
        state of the release before as release ``release``. Releases are published in order of their numbers."""
        before = self.state(release - 1)
        changed = delta(before, batch)
        # an item that isn't there can't be removed
        changed = changed.where("previous_revision_id is not null or new_revision_id is not null")
        folder = lambda part: f"{self.path}/{part}/release={release}"
        changed.write.mode("overwrite").parquet(folder("delta"))
        written = self._read("delta", "item_id string, previous_revision_id string, new_revision_id string", [release])
        full = not any(self.line(release - 1)) or self.spark.range(1).select(is_checkpoint(F.lit(release + 1), self.every)).first()[0]
        if full:
            merged(before, written).write.mode("overwrite").parquet(folder("full"))
        mode = F.lit("full" if full else "delta").alias("mode")
        written.agg(F.count("*").alias("changed")).select(mode, "changed").coalesce(1).write.mode("overwrite").parquet(folder("ledger"))


def relabelled(releases: DataFrame, active: str) -> DataFrame:
    """One published release; published ones before become superseded."""
    status = F.when(F.col("release_id") == active, "published").when(F.col("status") == "published", "superseded").otherwise(F.col("status"))
    return releases.withColumn("status", status)


def active_view(state: DataFrame, items: DataFrame, revisions: DataFrame, validations: DataFrame, as_of: Column) -> DataFrame:
    """Active records with the current validation (passed, unexpired, latest) and a trust that falls back to
    ``documentation_reviewed`` without one."""
    valid = validations.where((F.col("status") == "passed") & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of)))
    current = best_per_key(valid, ["revision_id"], [F.desc("executed_at"), F.col("validation_type")]).select("revision_id", "validation_type")
    out = state.join(items, "item_id").join(revisions, "revision_id").join(current, "revision_id", "left")
    return out.withColumn("validation_level", F.coalesce("validation_type", F.lit("documentation_reviewed"))).drop("validation_type")


def release_list(releases: DataFrame, changes: DataFrame) -> DataFrame:
    """Releases with their numbers of changes and the active flag."""
    n = changes.groupBy("release_id").agg(F.count("*").alias("changed"))
    return releases.join(n, "release_id", "left").withColumn("changed", F.coalesce("changed", F.lit(0))).withColumn("active", F.col("status") == "published")


def provenance_of(links: DataFrame, documents: DataFrame) -> DataFrame:
    """(revision_id, provenance): a revision's documents as JSON by URL; a revision has few."""
    rows = links.join(documents, "document_id")
    return rows.groupBy("revision_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("url", "role")))).alias("provenance"))


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """(url, content_hash, verified_at) with the latest verification."""
    return old.unionByName(new).groupBy("url", "content_hash").agg(F.max("verified_at").alias("verified_at"))


def changed_revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Revisions whose content hash isn't what it was; there should be none."""
    return before.join(after.withColumnRenamed("content_hash", "_new"), "revision_id").where(F.col("content_hash") != F.col("_new")).select("revision_id")
