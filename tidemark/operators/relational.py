"""Filters, joins, aggregates, windows and set operations over record tables.

Every function takes DataFrames and returns a lazy DataFrame. Clocks are passed in as ``as_of``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.files import shared_path

# --- filters and projections (P) ----------------------------------------------


def optional_filters(df: DataFrame, filters: Mapping[str, object | None]) -> DataFrame:
    """Equality with every parameter that isn't None; the filters reach the scan."""
    for name, value in filters.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """One page in a stable order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def contains_any(df: DataFrame, needle: str, columns: Sequence[str]) -> DataFrame:
    """Case-insensitive containment in any of the columns; ``%`` and ``_`` stand for themselves."""
    low = F.lit(needle.lower())
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), low), F.lit(False))
    return df.where(hit)


def json_contains(df: DataFrame, column: str, wanted: Mapping[str, str]) -> DataFrame:
    """The JSON object holds all the given keys with these scalar values."""
    for key, value in wanted.items():
        df = df.where(F.get_json_object(column, f"$.{key}") == value)
    return df


def member_of(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """The column is one of the values."""
    return df.where(F.col(column).isin(list(values)))


def ordinal(column: str, order: Sequence[str]) -> Column:
    """P5: position in a closed list, after the last for all others and null."""
    return F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(x) for x in order)), F.col(column)), F.lit(0)), F.lit(len(order) + 1))


def public_projection(df: DataFrame, allowed: Sequence[str], notes: Mapping[str, tuple[Column, str]]) -> DataFrame:
    """The allowed columns only, with ``limitations``: the texts of the conditions that hold, each once."""
    found = F.array(*(F.when(cond, F.lit(text)) for cond, text in notes.values()))
    return df.select(*allowed, F.array_distinct(F.filter(found, lambda x: x.isNotNull())).alias("limitations"))


def filled(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Defaults in place of nulls."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def without_null_entries(column: str) -> Column:
    """A map without entries whose value is null."""
    return F.map_filter(column, lambda _, v: v.isNotNull())


def safe_metadata(column: Column, allowed: Sequence[str]) -> Column:
    """Entries of a string map whose key is in a closed list."""
    return F.map_filter(column, lambda k, _: k.isin(list(allowed)))


# --- joins (J) ----------------------------------------------------------------


def star(fact: DataFrame, dims: Sequence[tuple[DataFrame, str, str]], how: str = "inner") -> DataFrame:
    """The fact with dimensions joined by (frame, fact key, dimension key); Spark broadcasts small ones."""
    for dim, left, right in dims:
        fact = fact.join(dim, fact[left] == dim[right], how)
    return fact


def exists(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """J3."""
    return df.join(other, on, "left_semi")


def not_exists(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """J4."""
    return df.join(other, on, "left_anti")


def not_excluded(df: DataFrame, exclusions: DataFrame, key: str, version: str, scopes: Sequence[str]) -> DataFrame:
    """Rows without an exclusion of their key whose version range holds theirs and whose scope columns
    are null or equal. Versions are arrays in array order; a null bound is open."""
    x = exclusions.alias("x")
    d = df.alias("d")
    on = F.col(f"d.{key}") == F.col(f"x.{key}")
    on &= F.col("x.vmin").isNull() | (F.col(f"d.{version}") >= F.col("x.vmin"))
    on &= F.col("x.vmax").isNull() | (F.col(f"d.{version}") <= F.col("x.vmax"))
    for s in scopes:
        on &= F.col(f"x.{s}").isNull() | (F.col(f"x.{s}") == F.col(f"d.{s}"))
    return d.join(x, on, "left_anti")


def by_scope(requests: DataFrame, records: DataFrame, family: str, levels: Mapping[str, str]) -> DataFrame:
    """Pairs of one family where the record's ``scope_level`` names a column on which both agree, or ``any``."""
    q, r = requests.alias("q"), records.alias("r")
    fits = F.col("r.scope_level") == "any"
    for level, column in levels.items():
        fits |= (F.col("r.scope_level") == level) & (F.col(f"q.{column}") == F.col(f"r.{column}"))
    return q.join(r, (F.col(f"q.{family}") == F.col(f"r.{family}")) & fits)


def latest_per(df: DataFrame, inner: DataFrame, on: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """For every outer row the inner row with the greatest order, or nulls. One aggregate, no window."""
    best = inner.groupBy(on).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_m"))
    return df.join(best, on, "left").select(*df.columns, *(F.col(f"_m.{c}").alias(c) for c in columns))


def aggregate_per(df: DataFrame, inner: DataFrame, on: str, **aggs: Column) -> DataFrame:
    """Inner aggregates for every outer row; counts without inner rows are null and left to the caller."""
    return df.join(inner.groupBy(on).agg(*(c.alias(n) for n, c in aggs.items())), on, "left")


def counters(df: DataFrame, **aggs: Column) -> DataFrame:
    """Many scalar sub-queries over one table as one pass."""
    return df.agg(*(c.alias(n) for n, c in aggs.items()))


def with_settings(df: DataFrame, **settings: object) -> DataFrame:
    """A one-row settings table as literal columns."""
    return df.withColumns({k: F.lit(v) for k, v in settings.items()})


def edges_of(nodes: DataFrame, edges: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Nodes with every edge at either end, and ``side``. Two equi-joins instead of an OR."""
    a = edges.select(F.col(left).alias(key), F.col(right).alias("other"), F.lit("left").alias("side"))
    b = edges.select(F.col(right).alias(key), F.col(left).alias("other"), F.lit("right").alias("side"))
    return nodes.join(a.unionByName(b), key)


def regex_join(df: DataFrame, text: str, patterns: DataFrame, pattern: str, max_patterns: int = 1000) -> DataFrame:
    """Pairs whose text matches the pattern, case-insensitively. The pattern table is a dimension:
    above ``max_patterns`` rows this raises, as every row is tried against every pattern."""
    n = patterns.limit(max_patterns + 1).count()
    if n > max_patterns:
        raise ValueError(f"more than {max_patterns} patterns")
    return df.join(F.broadcast(patterns), F.expr(f"`{text}` rlike concat('(?i)', `{pattern}`)"))


def dense_series(df: DataFrame, start: str, end: str, unit: str, bucket: str, keys: Mapping[str, object] | None = None) -> DataFrame:
    """Every ``unit`` from start to end, with the frame's rows of that ``bucket`` and 0 for missing numbers."""
    spark = df.sparkSession
    grid = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.expr(f"interval 1 {unit}"))).alias(bucket))
    rest = [c for c in df.columns if c != bucket]
    return grid.join(df, bucket, "left").select(bucket, *(F.coalesce(c, F.lit(0)).alias(c) for c in rest))


def literal_table(df: DataFrame, values: Sequence[str], column: str) -> DataFrame:
    """An ordered list of values as rows with ``ordinal``, left-joined with the frame."""
    rows = df.sparkSession.range(1).select(F.posexplode(F.array(*(F.lit(v) for v in values))).alias("ordinal", column))
    return rows.join(df, column, "left")


def update_from(df: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns replaced by the other table's non-null values of the same key."""
    n = new.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns))
    out = df.join(n, key, "left").withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns})
    return out.select(*df.columns)


# --- aggregates (G) -------------------------------------------------------------


def conditional_counts(df: DataFrame, by: Sequence[str], **conditions: Column) -> DataFrame:
    """G1: ``total`` and a count for every condition, in one pass."""
    return df.groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in conditions.items()))


def breakdowns(df: DataFrame, dimensions: Mapping[str, Column]) -> DataFrame:
    """Independent counts over several dimensions in one pass: (dimension, value, n)."""
    each = F.array(*(F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("value")) for n, c in dimensions.items()))
    return df.select(F.explode(each).alias("d")).groupBy("d.dimension", "d.value").agg(F.count("*").alias("n"))


def composite_distinct(*columns: str) -> Column:
    """Distinct combinations; nulls are skipped within the key, as in a joined text."""
    return F.countDistinct(F.concat_ws("|", *(F.col(c).cast("string") for c in columns)))


def distinct_where(value: str, cond: Column) -> Column:
    """Sorted distinct values where the condition holds, an empty array without any."""
    return F.array_sort(F.collect_set(F.when(cond, F.col(value))))


def nested_list(order: Sequence[str], fields: Sequence[str]) -> Column:
    """A group's rows as JSON, in order. For groups that are small by nature (one record's provenance)."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *(f for f in fields if f not in order))))
    return F.to_json(F.transform(rows, lambda r: F.struct(*(r[f].alias(f) for f in fields))))


def ratio(top: Column, bottom: Column, scale: int = 3) -> Column:
    """A quotient of fixed scale, null where the divisor is 0."""
    return F.round(F.try_divide(top.cast("double"), bottom.cast("double")), scale)


def usage_rollup(df: DataFrame, day: Column, keys: Sequence[str], duration: str) -> DataFrame:
    """Requests and total duration by day and keys; additive, so rollups of parts can be summed."""
    return df.groupBy(day.alias("day"), *keys).agg(F.count("*").alias("request_count"), F.sum(duration).alias("total_duration"))


def merge_rollups(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sum of two rollups."""
    return old.unionByName(new).groupBy("day", *keys).agg(F.sum("request_count").alias("request_count"), F.sum("total_duration").alias("total_duration"))


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """The value at rank ceil(n * share), for each share, exactly. Ranks come from counts of distinct
    values, so a group of many rows isn't gathered: running counts go over its distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    w = W.partitionBy(*by).orderBy(value)
    run = counts.withColumn("_upto", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(W.partitionBy(*by)))
    picks = [F.min(F.when(F.col("_upto") >= F.ceil(F.col("_all") * F.lit(s)), F.col(value))).alias(n) for n, s in shares.items()]
    return run.groupBy(*by).agg(F.max("_all").alias("n"), *picks, F.max(value).alias("max"))


def group_transitions(df: DataFrame, keys: Sequence[str], count: str, at: str, last: int) -> DataFrame:
    """Transitions merged by keys (sum, latest time); the ``last`` latest."""
    out = df.groupBy(*keys).agg(F.sum(count).alias(count), F.max(at).alias(at))
    return out.orderBy(F.desc(at), *keys).limit(last)


def utilisation(busy: Column, span: Column, capacity: Column) -> Column:
    """Busy time over available time in percent, at most 100, null without a span."""
    return F.least(F.lit(100.0), F.round(F.try_divide(busy.cast("double") * 100, (span * capacity).cast("double")), 1))


def breakdown_manifest(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: the breakdown as sorted JSON, its total, and its SHA-256."""
    b = df.groupBy(*keys).agg(F.count("*").alias("n"))
    rows = F.array_sort(F.collect_list(F.struct(*keys, "n")))
    return b.agg(F.sum("n").alias("total"), F.to_json(rows).alias("breakdown")).withColumn("manifest", F.sha2("breakdown", 256))


# --- windows, top-k (W) ---------------------------------------------------------


def fair_merge(df: DataFrame, flag: str, order: Sequence[Column], limit: int) -> DataFrame:
    """Classes interleaved by rank. Each class is cut to ``limit`` rows before ranks are compared."""
    ranked = df.withColumn("class_rank", F.row_number().over(W.partitionBy(flag).orderBy(*order)))
    return ranked.where(F.col("class_rank") <= limit).orderBy("class_rank", flag).limit(limit)


def with_total(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """A page whose rows carry the count of all rows; the count is an aggregate, not a window."""
    total = df.agg(F.count("*").alias("total"))
    return page(df, order, offset, limit).join(F.broadcast(total))


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def last_write(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The row with the greatest sequence of each key; map-side combining, no sort."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_m")).select(key, *(F.col(f"_m.{c}").alias(c) for c in rest))


def next_numbers(new: DataFrame, existing: DataFrame, key: str, number: str, order: Sequence[str]) -> DataFrame:
    """Consecutive numbers after each key's largest existing one."""
    base = existing.groupBy(key).agg(F.max(number).alias("_base"))
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return new.withColumn("_r", rank).join(base, key, "left").withColumn(number, F.coalesce("_base", F.lit(0)) + F.col("_r")).drop("_base", "_r")


def relative_cut(df: DataFrame, by: str, rank: str, share: float = 0.5, floor: float = 0.01) -> DataFrame:
    """Rows whose rank is at least ``share`` of their group's largest, and at least ``floor``."""
    top = df.groupBy(by).agg(F.max(rank).alias("_top"))
    return df.join(top, by).where(F.col(rank) >= F.greatest(F.col("_top") * share, F.lit(floor))).drop("_top")


def top_with_nulls(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """W9."""
    return df.orderBy(*order).limit(n)


def budget_prefix(df: DataFrame, by: str, order: Sequence[str], size: str, budget: int, rows: int) -> DataFrame:
    """Of each group the longest prefix within a size budget and ``rows`` rows; the first row always.
    Rows past ``rows`` leave before sizes are summed."""
    w = W.partitionBy(by).orderBy(*order)
    out = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= rows)
    out = out.withColumn("_sum", F.sum(size).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return out.where((F.col("_r") == 1) | (F.col("_sum") <= budget)).drop("_r", "_sum")


def carried_forward(column: str, by: str, order: Sequence[str]) -> Column:
    """The last non-null value so far."""
    return F.last(column, ignorenulls=True).over(W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))


def failure_streaks(df: DataFrame, owner: str, at: str, failed: Column, code: str, as_of: Column, n: int = 3, minutes: int = 15) -> DataFrame:
    """Owners whose last ``n`` runs of the past minutes all failed with one code."""
    recent = df.where((F.col(at) <= as_of) & (F.col(at) > as_of - F.expr(f"interval {minutes} minutes")))
    last = recent.withColumn("_r", F.row_number().over(W.partitionBy(owner).orderBy(F.desc(at)))).where(F.col("_r") <= n)
    out = last.groupBy(owner).agg(F.count_if(failed).alias("failures"), F.countDistinct(code).alias("codes"), F.max(code).alias("code"))
    return out.where((F.col("failures") == n) & (F.col("codes") == 1)).select(owner, "code", "failures")


# --- set operations, recursion (U) -------------------------------------------------


def stage_counts(tables: Mapping[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(stage, n) of several tables, each with its condition."""
    out = None
    for stage, (df, cond) in tables.items():
        one = df.agg(F.count_if(cond).alias("n")).select(F.lit(stage).alias("stage"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def latest_of_histories(histories: Sequence[DataFrame], key: str, seq: str) -> DataFrame:
    """The greatest sequence of each key over several histories."""
    out = histories[0].select(key, seq)
    for h in histories[1:]:
        out = out.unionByName(h.select(key, seq))
    return out.groupBy(key).agg(F.max(seq).alias(seq))


def aligned_union(*frames: DataFrame) -> DataFrame:
    """Run logs of different shapes; missing columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def closure(spark, edges: DataFrame, roots: DataFrame, child: str, parent: str, stop: DataFrame | None = None) -> DataFrame:
    """(root, node, depth) of everything reachable from the roots over child-to-parent edges, with the
    least depth. Each round joins the new frontier only, until none is left, and is written to the shared folder, so lineage stays
    short. Nodes in ``stop`` (node) are reached but not passed."""
    frontier = roots.select(F.col(roots.columns[0]).alias("root"), F.col(roots.columns[0]).alias("node"), F.lit(0).alias("depth")).distinct()
    schema, path = frontier.schema, shared_path(spark, "closure")
    e = edges.select(F.col(child).alias("node"), F.col(parent).alias("_to")).where("_to is not null").distinct()
    if stop is not None:
        e = e.join(stop.select("node"), "node", "left_anti")

    def level(df: DataFrame, k: int) -> DataFrame:
        df.write.parquet(f"{path}/{k}")
        return spark.read.schema(schema).parquet(f"{path}/{k}")

    frontier, k = level(frontier, 0), 0
    while not frontier.isEmpty():  # it ends by itself, as pairs seen before are left out
        k += 1
        seen = spark.read.schema(schema).parquet(*(f"{path}/{i}" for i in range(k)))
        new = frontier.join(e, "node").select("root", F.col("_to").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        frontier = level(new.join(seen, ["root", "node"], "left_anti"), k)
    return spark.read.schema(schema).parquet(*(f"{path}/{i}" for i in range(k + 1)))


def ordered_union(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Distinct keys in the order first seen (``ordinal`` of the first table before the second)."""
    both = first.select(key, F.struct(F.lit(0).alias("t"), F.col("ordinal")).alias("o")).unionByName(second.select(key, F.struct(F.lit(1).alias("t"), F.col("ordinal")).alias("o")))
    return both.groupBy(key).agg(F.min("o").alias("o")).select(key, F.col("o.t").alias("source"), F.col("o.ordinal").alias("ordinal"))
