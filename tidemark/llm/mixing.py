"""Mixing sources to target weights by hierarchical budgeting.

A token budget is propagated down a tree of columns (domain, language, source). Siblings share
their parent's budget in proportion to their weights; what a child can't fill (its documents
repeated ``max_epochs`` times) goes to its siblings, and only what the whole branch can't fill
goes to the branch's siblings, because a branch's budget never exceeds its capacity. A leaf reads
its documents in epochs, each in a seeded order of its own: all of the full epochs, and of the
last the token-prefix that fits the rest of its budget.

The cut of the last epoch is found without putting a leaf in one task: documents fall into
buckets of the seeded order, running sums go over bucket totals, and only the bucket that holds
the cut is summed document by document.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import Scratch, fresh

#: Leaves up to which the table of cuts is broadcast, and documents to a bucket, on average.
MAX_LEAVES, BUCKET = 20_000, 1_000
_BITS = 60


def order_key(seed: int, epoch: Column, key: Column) -> Column:
    """A number under 2**60 that orders documents within an epoch."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key), 256), 1, 15), 16, 10).cast("long")


def _share(nodes: DataFrame, parent: list[str], child: str, budget: Column) -> DataFrame:
    """``nodes`` (parent, child, cap, weight, and ``budget`` of the parent) with ``got``: the parent's
    budget in proportion to the weights, no child over its cap, shortages to the siblings."""
    by = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    fill = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight"))
    order = by.orderBy(fill.asc_nulls_last(), F.col(child))
    rows = W.unboundedPreceding, -1
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(*rows)), F.lit(0.0))
    weight = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    out = nodes.withColumn("_before", before).withColumn("_weight", weight).withColumn("_at", F.row_number().over(order))
    left = F.when(F.col("_weight") > 0, (budget - F.col("_before")) / F.col("_weight"))
    full = (F.col("weight") > 0) & (F.col("cap") <= left * F.col("weight"))
    out = out.withColumn("_full", full).withColumn("_rate", F.min_by(F.when(~F.col("_full"), left), F.when(~F.col("_full"), F.col("_at"))).over(by))
    got = F.when(F.col("_full"), F.col("cap")).when(F.col("weight") > 0, F.least(F.col("cap"), F.col("_rate") * F.col("weight"))).otherwise(0.0)
    return out.withColumn("got", got).drop("_before", "_weight", "_at", "_full", "_rate")


def leaf_budgets(leaves: DataFrame, tree: list[str], weights: Mapping[str, Mapping[str, float]], fraction: float, max_epochs: int) -> DataFrame:
    """``leaves`` (tree columns, ``tokens``, ``docs``) with ``got``: the tokens each leaf may give."""
    def weight(level: str) -> Column:
        given = weights.get(level, {})
        out = F.lit(1.0) if not given else F.lit(float(given.get("*", 0.0)))
        for value, w in given.items():
            if value != "*":
                out = F.when(F.col(level) == value, F.lit(float(w))).otherwise(out)
        return out

    cur = leaves.withColumn("cap", F.col("tokens") * F.lit(float(max_epochs)))
    parts = None
    for depth, level in enumerate(tree):
        path, parent = tree[: depth + 1], tree[:depth]
        nodes = cur.groupBy(*path).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("weight", weight(level))
        nodes = nodes.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(0.0))
        if parent:
            nodes = nodes.join(parts.select(*parent, F.col("got").alias("_budget")), parent)
            parts = _share(nodes, parent, level, F.col("_budget")).drop("_budget")
        else:
            total = F.sum("tokens").over(W.partitionBy(F.lit(0))) * F.lit(float(fraction))
            nodes = nodes.withColumn("_budget", F.least(total, F.sum("cap").over(W.partitionBy(F.lit(0)))))
            parts = _share(nodes, parent, level, F.col("_budget")).drop("_budget")
    return leaves.join(parts.select(*tree, "got"), tree)


def mix(
    docs: DataFrame,
    tree: Mapping[str, Column],
    weights: Mapping[str, Mapping[str, float]],
    fraction: float = 1.0,
    max_epochs: int = 4,
    seed: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The chosen rows, once for each epoch, with ``epoch`` (from 1) and ``n_tokens``.

    ``tree`` names the levels from the root and gives each as a column; ``weights`` holds, by
    level, weights by value (``"*"``: of values not named, else 0; a level without an entry:
    equal). ``fraction`` of all tokens (blank-separated words) is the budget. Null level values
    are the value ``(null)``. Null and empty texts have no tokens and go with the prefix they
    fall into; a leaf without any tokens is taken once if its weights are positive. Equal ids in a leaf share a place in the order, and
    are in or out together; null ids share one. An empty table gives no rows. Columns named
    ``epoch`` or ``n_tokens`` are replaced.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() not in ("epoch", "n_tokens")]
    own = fresh(docs, "_m")  # of the operator's own columns beside the rows'
    names = [f"{own}{i}" for i in range(len(tree))]
    levels = [F.coalesce(c.cast("string"), F.lit("(null)")).alias(n) for n, c in zip(names, tree.values(), strict=True)]
    by_name = {n: weights[k] for n, k in zip(names, tree, strict=True) if k in weights}
    tokens = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^ \t\n\r\f\x0B]+")), F.lit(0)).cast("long")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("(null)"))
    rows = docs.select(*kept, *levels, tokens.alias(f"{own}_tokens"), key.alias(f"{own}_key"))
    scratch = Scratch(spark, "mix")
    narrow = scratch.save(rows.select(*names, F.col(f"{own}_key").alias("_key"), F.col(f"{own}_tokens").alias("n_tokens")), "narrow")
    leaves = narrow.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    leaves = leaf_budgets(leaves, names, by_name, fraction, max_epochs)
    epochs = F.when(F.col("tokens") > 0, F.floor((F.col("got") + 1e-6) / F.col("tokens"))).otherwise(F.when(F.col("docs") > 0, F.lit(0))).cast("long")
    leaves = leaves.withColumn("full", F.least(epochs, F.lit(max_epochs).cast("long")))
    leaves = leaves.withColumn("rest", F.floor(F.col("got") + 1e-6).cast("long") - F.col("full") * F.col("tokens"))
    leaves = scratch.save(leaves.withColumn("buckets", F.ceil(F.col("docs") / F.lit(float(BUCKET))).cast("long")), "leaves")
    few = leaves.count() <= MAX_LEAVES
    small = F.broadcast if few else (lambda df: df)

    hashed = narrow.join(small(leaves.where("rest > 0 and tokens > 0").select(*names, "full", "rest", "buckets")), names)
    hashed = hashed.withColumn("_h", order_key(seed, F.col("full") + 1, F.col("_key")))
    hashed = hashed.withColumn("_b", F.shiftright(F.shiftright("_h", _BITS // 2) * F.col("buckets"), _BITS // 2))
    totals = hashed.groupBy(*names, "_b").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))
    # running sums over buckets, and over groups of BUCKET buckets first, so that no task sums a whole leaf
    totals = totals.withColumn("_g", F.floor(F.col("_b") / BUCKET))
    groups = totals.groupBy(*names, "_g").agg(F.sum("t").alias("g"))
    groups = groups.withColumn("_ahead", F.coalesce(F.sum("g").over(W.partitionBy(*names).orderBy("_g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("g")
    totals = totals.join(groups, [*names, "_g"]).withColumn("_upto", F.col("_ahead") + F.sum("t").over(W.partitionBy(*names, "_g").orderBy("_b")))
    # the first bucket that goes over the rest holds the cut; without one the whole epoch fits
    over = totals.where("_upto > rest").groupBy(*names).agg(F.min(F.struct("_b", (F.col("_upto") - F.col("t")).alias("before"))).alias("m"))
    over = over.select(*names, F.col("m._b").alias("_b"), F.col("m.before").alias("_before"))
    inside = hashed.join(small(over), [*names, "_b"])
    run = F.col("_before") + F.sum("n_tokens").over(W.partitionBy(*names, "_b").orderBy("_h", "_key"))
    first_out = inside.withColumn("_run", run).where("_run > rest").groupBy(*names).agg(F.min(F.struct("_h", "_key")).alias("cut"))
    cuts = scratch.save(leaves.select(*names, "full", "rest", "tokens", "got").join(first_out, names, "left"), "cuts")

    cut = F.col(f"{own}_cut")
    out = rows.join(small(cuts.select(*names, F.struct("full", "rest", "tokens", F.col("cut._h").alias("h"), F.col("cut._key").alias("key")).alias(f"{own}_cut"))), names)
    h, place = order_key(seed, cut["full"] + 1, F.col(f"{own}_key")), F.col(f"{own}_key")
    under = cut["h"].isNull() | (h < cut["h"]) | ((h == cut["h"]) & (place < cut["key"]))
    fits = F.when(cut["tokens"] == 0, cut["full"] == 0).otherwise((cut["rest"] > 0) & under)
    last = cut["full"] + F.coalesce(fits, F.lit(False)).cast("long")
    out = out.withColumn(f"{own}_last", last).where(F.col(f"{own}_last") > 0)
    return out.select(*kept, F.col(f"{own}_tokens").alias("n_tokens"), F.explode(F.sequence(F.lit(1).cast("long"), f"{own}_last")).alias("epoch"))
