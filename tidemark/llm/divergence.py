"""Source divergence audit: how far the word use of the sources of a language lies apart, term by term and source by source.

Every group (language, source) has a share ``p`` of each term kept in its language, in billionths, with one added to each count.
The divergence of a group from another is the sum of ``(p - q)^2 / q`` over all kept terms, zeros included. It is formed row by
row as in Gustavson's sparse product: a group's row scatters each of its terms through the term-major index (who else has the
term, with which share) into a dense accumulator with one cell a peer, so no pair of postings is ever emitted; a block of terms
emits one number for each pair of groups. Terms that one or both groups lack are not in any posting. With ``p0`` and ``q0`` the
shares of a count of zero,

    sum f(p, q) = V f(p0, q0) + sum over g of [f(p, q0) - f(p0, q0)] + sum over h of [f(p0, q) - f(p0, q0)]
                + sum over both of [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)],

of which the second and third need only how often each share occurs in a group, and the last is what is scattered.

All arithmetic is in whole numbers. Defined cases: null text, language and source are empty strings; every row is a document, so
repeated rows count as often as they stand; a language without kept terms has all values 0; a language with one source has no
pairs; a table without rows gives none. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import ALPHA_RUNS, Scratch, Words, text_chunks

#: Shares are in parts of this; three steps of a thousand keep a share exact in 64 bits.
SCALE = 1_000_000_000
#: Documents of its language that a kept term stands in, and terms reported for a group.
MIN_DOCS, TOP_TERMS = 3, 200
#: Postings of a block of terms, at least and at most: in between, the square of the number of a language's groups, so that a block
#: emits no more than it reads; and pairs of postings that are scattered at once.
BLOCK, LARGEST_BLOCK, SCATTER = 50_000, 1_000_000, 1_000_000
#: Groups up to which their totals are broadcast (about 100 bytes each); more are joined.
FEW_GROUPS = 100_000
#: Rows gathered in a task before they are added up, and kept on after that.
GATHER, HOLD = 300_000, 150_000


# --- counts ------------------------------------------------------------------------


def _chunk_counts(low: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> pa.Table:
    """(g, term, n, d) of consecutive texts of the groups given."""
    w = Words(low, offsets, ALPHA_RUNS, hashed=False)
    size = w.end - w.start
    ends = np.concatenate([[0], np.cumsum(size)])
    inside = np.repeat(w.start - ends[:-1], size) + np.arange(ends[-1])
    words = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(low[inside].tobytes()))
    coded = words.dictionary_encode()
    text = np.repeat(np.arange(len(groups)), np.diff(w.first))
    width = max(1, len(coded.dictionary))
    each, n = np.unique(text * width + coded.indices.to_numpy(), return_counts=True)
    key, at = np.unique(groups[each // width] * width + each % width, return_inverse=True)
    total = np.zeros(len(key), dtype=np.int64)
    np.add.at(total, at, n)
    return pa.table({"g": key // width, "term": coded.dictionary.take(pa.array(key % width)), "n": total, "d": np.bincount(at, minlength=len(key)).astype(np.int64)})


def _added(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(["g", "term"]).aggregate([("n", "sum"), ("d", "sum")]).rename_columns(["g", "term", "n", "d"])


def _task_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, d), added up as far as memory holds them."""
    number: dict[tuple[str, str], int] = {}
    waiting: list[pa.Table] = []

    def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
        names = list(number)
        lang, source = (pa.array([x[i] for x in names], pa.string()).take(t["g"].combine_chunks()) for i in (0, 1))
        done = pa.table({"lang": lang, "source": source, "term": t["term"].cast(pa.string()), "n": t["n"], "d": t["d"]})
        yield from done.to_batches(max_chunksize=100_000)

    for batch in batches:
        pairs = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
        groups = np.array([number.setdefault(p, len(number)) for p in pairs], dtype=np.int64)
        for lo, hi, low, offsets in text_chunks(batch.column("text")):
            waiting.append(_chunk_counts(low, offsets, groups[lo:hi]))
            if sum(t.num_rows for t in waiting) > GATHER:
                waiting = [_added(waiting)]
                if waiting[0].num_rows > HOLD:
                    yield from out(waiting.pop())
    if waiting:
        yield from out(_added(waiting))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents of each term in each group of (lang, source, text)."""
    text = F.coalesce("text", F.lit(""))
    read = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), text.alias("text"))
    found = read.mapInArrow(_task_counts, "lang string, source string, term string, n long, d long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


# --- shares --------------------------------------------------------------------------


def _share(df: DataFrame, name: str, count: str, total: str) -> DataFrame:
    """``df`` with ``name``: 1 + floor(SCALE * (count + 1) / total), or 1 where the total is 0. As count < total, long division by
    three steps of a thousand stays exact while the total is under 9e15."""
    df = df.withColumn("_r", F.expr(f"{count} + 1")).withColumn("_p", F.lit(0).cast("long")).withColumn("_t", F.expr(f"greatest({total}, 1)"))
    for _ in range(3):
        df = df.withColumn("_p", F.expr("_p * 1000 + _r * 1000 div _t")).withColumn("_r", F.expr("_r * 1000 % _t"))
    return df.withColumn(name, F.expr(f"CASE WHEN {total} > 0 THEN _p + 1 ELSE 1L END")).drop("_r", "_p", "_t")


def _small(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


class Shares:
    """Written tables: ``groups`` (lang, source, v, total, p0) of all groups, and ``postings`` (lang, source, term, n, p, p0, q): the
    kept terms that a group has, its share of each, its share of a count of zero, and the share of the language."""

    def __init__(self, docs: DataFrame, scratch: Scratch, min_docs: int = MIN_DOCS) -> None:
        self.scratch = scratch
        by_term = W.partitionBy("lang", "term")
        counts = term_counts(docs).withColumn("_docs", F.sum("d").over(by_term)).where(F.col("_docs") >= min_docs)
        counts = counts.withColumn("in_lang", F.sum("n").over(by_term)).withColumn("lead", (F.row_number().over(by_term.orderBy("source")) == 1).cast("long"))
        kept = scratch.save(counts.drop("_docs", "d"), "kept")
        langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("lead").alias("v"))
        sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
        groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
        groups = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *(F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("own", "lang_n", "v")))
        groups = groups.withColumn("total", F.col("own") + F.col("v")).withColumn("_zero", F.lit(0).cast("long"))
        self.groups = scratch.save(_share(groups, "p0", "_zero", "total").drop("_zero"), "groups")
        self.few = self.groups.count() <= FEW_GROUPS
        rows = kept.join(_small(self.groups.select("lang", "source", "v", "lang_n", "total", "p0"), self.few), ["lang", "source"])
        rows = _share(_share(rows, "p", "n", "total"), "q", "in_lang", "lang_n + v")
        self.postings = scratch.save(rows.select("lang", "source", "term", "n", "p", "p0", "q"), "postings")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


# --- pairs -----------------------------------------------------------------------------


def scattered(source: np.ndarray, term: np.ndarray, p: np.ndarray, p0: np.ndarray, n_groups: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each group of a block, the peers that share a term with it and the sums of the last bracket above.

    ``source`` and ``term`` are numbers; ``p0`` is by group. A row's terms are looked up in the term-major index, ``SCATTER``
    pairs at a time, and added into one dense accumulator.
    """
    by_term = np.argsort(term, kind="stable")
    starts = np.searchsorted(term[by_term], np.arange(term.max() + 2))
    peer, q = source[by_term], p[by_term]
    by_row = np.argsort(source, kind="stable")
    rows = np.searchsorted(source[by_row], np.arange(n_groups + 1))
    for g in range(n_groups):
        own = by_row[rows[g] : rows[g + 1]]
        if not len(own):
            continue
        cells, seen = np.zeros(n_groups, dtype=np.int64), np.zeros(n_groups, dtype=bool)
        lo, size = starts[term[own]], starts[term[own] + 1] - starts[term[own]]
        cuts = np.searchsorted(np.cumsum(size), np.arange(0, size.sum() + SCATTER, SCATTER), side="right")
        for a, b in zip(cuts[:-1], [*cuts[1:-1], len(own)]):
            if a == b:
                continue
            n = size[a:b]
            at = np.repeat(lo[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            h, x, y = peer[at], np.repeat(p[own[a:b]], n), q[at]
            np.add.at(cells, h, _f(x, y) - _f(x, p0[h]) - _f(p0[g], y) + _f(p0[g], p0[h]))
            seen[h] = True
        seen[g] = False
        others = np.flatnonzero(seen)
        yield g, others, cells[others]


def _block_pairs(key: tuple, block: pa.Table) -> pa.Table:
    source, term = (block[c].combine_chunks().dictionary_encode() for c in ("source", "term"))
    number, names = source.indices.to_numpy().astype(np.int64), source.dictionary
    p0 = np.zeros(len(names), dtype=np.int64)
    p0[number] = block["p0"].to_numpy()
    parts = list(scattered(number, term.indices.to_numpy().astype(np.int64), block["p"].to_numpy(), p0, len(names)))
    g = np.concatenate([np.full(len(h), g, dtype=np.int64) for g, h, _ in parts])
    h, v = (np.concatenate([x[i] for x in parts]) for i in (1, 2))
    return pa.table({"lang": pa.array([key[0].as_py()] * len(g), pa.string()), "source": names.take(pa.array(g)), "item": names.take(pa.array(h)), "value": v})


def pair_values(shares: Shares) -> DataFrame:
    """(lang, source, item, value): the divergence of each group from each other source of its language."""
    rows = shares.postings.select("lang", "source", "term", "p", "p0")
    most = shares.groups.groupBy("lang").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    blocks = rows.count() // min(max(BLOCK, most**2), max(BLOCK, LARGEST_BLOCK)) + 1
    pairs = "lang string, source string, item string, value long"
    shared = rows.withColumn("_b", F.pmod(F.xxhash64("term"), F.lit(blocks))).groupBy("lang", "_b").applyInArrow(lambda key, block: _block_pairs(key, block), pairs)
    # what a group's row gives with each peer's zero share, in the role of p and in the role of q
    often = rows.groupBy("lang", "source", "p").agg(F.count("*").alias("n")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "n")).alias("often"))
    peers = shares.groups.groupBy("lang").agg(F.collect_list(F.struct("source", "p0")).alias("peers"))
    lone = shares.groups.select("lang", "source", "v", "p0").join(often, ["lang", "source"], "left").join(_small(peers, shares.few), "lang")
    f = lambda p, q: f"(({p} - {q}) * ({p} - {q}) div {q})"
    gap = "aggregate(coalesce(often, cast(array() as array<struct<p: bigint, n: bigint>>)), 0L, (a, o) -> a + o.n * ({} - {}))"
    as_p = f"v * {f('p0', 'x.p0')} + {gap.format(f('o.p', 'x.p0'), f('p0', 'x.p0'))}"
    as_q = gap.format(f("x.p0", "o.p"), f("x.p0", "p0"))
    lone = lone.select("lang", "source", F.expr(f"explode(transform(filter(peers, x -> x.source != source), x -> struct(x.source as peer, {as_p} as p, {as_q} as q)))").alias("x"))
    lone = lone.select("lang", F.expr("inline(array(struct(source, x.peer as item, x.p as value), struct(x.peer as source, source as item, x.q as value)))"))
    both = lone.select("lang", "source", "item", "value").unionByName(shared)
    return both.groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))


def term_values(shares: Shares, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a group uses more than its language, ``top`` of them."""
    more = shares.postings.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    w = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return more.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` for every other source of the language, part ``term`` for the ``top``
    terms, ranked by value, then by the bytes of the item."""
    shares = Shares(docs, Scratch(docs.sparkSession, "divergence"), min_docs)
    w = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(shares).withColumn("rank", F.row_number().over(w)).withColumn("part", F.lit("pair"))
    terms = term_values(shares, top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
