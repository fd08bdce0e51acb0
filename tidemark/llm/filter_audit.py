"""Filter interaction audit: what each quality filter removes, in every order of the filters.

One pass of a table-driven finite-state transducer reads the bytes of a text: a byte has a class, the class and the state
(outside or inside a word) give the next state and the actions: a word begins or ended, a capital, a code point, a symbol.
The spans of the words go into an open-addressing hash table that takes two spans for one word only after comparing their
bytes, so the number of distinct words is exact. Everything after the pass is grouping of counts.

Defined cases: a null text is empty (no words, no characters; it fails A, and E if a smaller id's text is empty too); a null
part is the empty string; a null id has no smaller or larger ids, so such a row neither fails E nor makes others fail; rows
repeated under one id are counted each, and fail E only against smaller ids; of several labels of an id one with quality or
toxic 1 suffices; a table without rows gives no rows. Columns other than those named take no part.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import mix, span_hashes, text_chunks


@dataclass(frozen=True)
class Limits:
    """What the filters A to D ask of a text; E asks that no smaller id has the same text."""

    min_words: int = 50
    distinct_percent: int = 65
    capital_percent: int = 5
    symbols: str = "#$%&*|"


FILTERS = "ABCDE"

# --- the transducer -------------------------------------------------------------

_SEPARATOR, _PLAIN, _CAPITAL, _SYMBOL, _TAIL = range(5)
_OUTSIDE, _INSIDE = range(2)
_BEGINS, _ENDED, _IS_CAPITAL, _IS_POINT, _IS_SYMBOL = (1 << i for i in range(5))
_SAME = np.arange(256, dtype=np.uint8)


def byte_classes(symbols: str) -> np.ndarray:
    """Class of each byte; symbols are ASCII characters that neither separate words nor are capitals."""
    out = np.full(256, _PLAIN, dtype=np.uint8)
    out[[0x20, *range(0x09, 0x0E)]] = _SEPARATOR
    out[0x41:0x5B] = _CAPITAL
    out[0x80:0xC0] = _TAIL
    out[[ord(c) for c in symbols]] = _SYMBOL
    return out


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state by class (the state before doesn't change it), and actions by (state, class)."""
    follows = np.array([_OUTSIDE, _INSIDE, _INSIDE, _INSIDE, _INSIDE], dtype=np.uint8)
    acts = np.zeros((2, 5), dtype=np.uint8)
    acts[_INSIDE, _SEPARATOR] |= _ENDED
    acts[_OUTSIDE, [_PLAIN, _CAPITAL, _SYMBOL, _TAIL]] |= _BEGINS
    acts[:, _CAPITAL] |= _IS_CAPITAL
    acts[:, _SYMBOL] |= _IS_SYMBOL
    acts[:, [_SEPARATOR, _PLAIN, _CAPITAL, _SYMBOL]] |= _IS_POINT
    return follows, acts


_FOLLOWS, _ACTS = _transitions()


class Pass:
    """Counts for each of consecutive texts, and the spans of their words."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> None:
        kind = classes[raw]
        state = np.empty(len(raw) + 1, dtype=np.uint8)
        state[1:] = _FOLLOWS[kind]
        after = state[offsets[1:]]  # of each text's last byte, unless the text is empty
        state[offsets[:-1]] = _OUTSIDE
        acts = _ACTS[state[:-1], kind]
        begins = np.flatnonzero(acts & _BEGINS)
        open_ = (after == _INSIDE) & (offsets[1:] > offsets[:-1])
        self.start, self.end = begins, np.sort(np.concatenate([np.flatnonzero(acts & _ENDED), offsets[1:][open_]]))
        self.first = np.searchsorted(begins, offsets)
        each = lambda act: np.diff(np.searchsorted(np.flatnonzero(acts & act), offsets))
        self.capitals, self.points, self.symbols = each(_IS_CAPITAL), each(_IS_POINT), each(_IS_SYMBOL)


# --- the verified hash table ------------------------------------------------------

_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
#: Bytes up to which two spans are compared eight at a time, all pairs at once; longer pairs one by one.
_LONG = 256


class SpanTable:
    """Distinct byte spans of each owner by open addressing with linear probing, at most half full."""

    def __init__(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, owner: np.ndarray) -> None:
        self.raw, self.start, self.size, self.owner = raw, start, end - start, owner
        padded = np.concatenate([raw, np.zeros(8, dtype=np.uint8)])
        self.eight = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
        head = self.eight[start] & _MASKS[np.minimum(self.size, 8)]
        tail = self.eight[np.maximum(end - 8, start)] & _MASKS[np.minimum(self.size, 8)]
        self.hash = mix(head ^ mix(tail + self.size.astype(np.uint64)) ^ mix(owner.astype(np.uint64)))
        long = np.flatnonzero(self.size > 16)  # head and tail don't cover these
        if len(long):
            self.hash[long] ^= span_hashes(raw, (start[long], end[long]))[0]

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether spans a and b have one owner and the same bytes."""
        out = (self.owner[a] == self.owner[b]) & (self.size[a] == self.size[b])
        left = np.flatnonzero(out & (self.size[a] <= _LONG))
        at = 0
        while len(left):
            x, y = a[left], b[left]
            differ = (self.eight[self.start[x] + at] ^ self.eight[self.start[y] + at]) & _MASKS[np.minimum(self.size[x] - at, 8)]
            out[left[differ != 0]] = False
            at += 8
            left = left[(differ == 0) & (self.size[x] > at)]
        for i in np.flatnonzero(out & (self.size[a] > _LONG)):
            s, t, n = self.start[a[i]], self.start[b[i]], self.size[a[i]]
            out[i] = np.array_equal(self.raw[s : s + n], self.raw[t : t + n])
        return out

    def distinct(self) -> np.ndarray:
        """True for one span of each distinct word of an owner."""
        n = len(self.start)
        slots = np.full(1 << max(4, (2 * n).bit_length()), -1, dtype=np.int64)
        at = (self.hash & np.uint64(len(slots) - 1)).astype(np.int64)
        holds, waiting = np.zeros(n, dtype=bool), np.arange(n)
        while len(waiting):
            place = at[waiting]
            free = slots[place] < 0
            slots[place[free]] = waiting[free]  # of those that claim one slot at once, one gets it
            held = slots[place]
            holds[waiting[held == waiting]] = True
            waiting, held = waiting[held != waiting], held[held != waiting]
            waiting = waiting[~self.same(waiting, held)]
            at[waiting] = (at[waiting] + 1) & (len(slots) - 1)
        return holds


MEASURES = {"n_words": pa.int64(), "n_distinct": pa.int64(), "n_capitals": pa.int64(), "n_chars": pa.int64(), "n_symbols": pa.int64(), "digest": pa.binary()}


def _counts(column: pa.Array, classes: np.ndarray) -> dict[str, pa.Array]:
    found: dict[str, list] = {k: [] for k in MEASURES}
    for lo, hi, raw, offsets in text_chunks(column, _SAME):
        p = Pass(raw, offsets, classes)
        n = np.diff(p.first)
        owner = np.repeat(np.arange(hi - lo), n)
        distinct = np.bincount(owner[SpanTable(raw, p.start, p.end, owner).distinct()], minlength=hi - lo)
        data = memoryview(np.ascontiguousarray(raw))
        for k, v in (("n_words", n), ("n_distinct", distinct), ("n_capitals", p.capitals), ("n_chars", p.points), ("n_symbols", p.symbols)):
            found[k].append(v)
        found["digest"] += [hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    return {k: pa.array(found[k] if k == "digest" else np.concatenate(found[k]) if found[k] else [], kind) for k, kind in MEASURES.items()}


def measures(docs: DataFrame, text: str = "text", symbols: str = Limits.symbols) -> DataFrame:
    """``docs`` with ``n_words, n_distinct, n_capitals, n_chars, n_symbols`` of each text and its SHA-256 ``digest`` instead of the text."""
    rest = [f for f in docs.schema.fields if f.name != text]
    classes = byte_classes(symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = _counts(batch.column(text), classes)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), *new.values()], names=[*(f.name for f in rest), *new])

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), *(f"{k} {'binary' if k == 'digest' else 'long'}" for k in MEASURES)])
    return docs.mapInArrow(run, kinds)


# --- the audit ----------------------------------------------------------------------


def failures(limits: Limits = Limits()) -> Column:
    """Bits 0 to 3 for the filters A to D that a row of ``measures`` fails."""
    fails = (
        F.col("n_words") < limits.min_words,
        100 * F.col("n_distinct") < limits.distinct_percent * F.col("n_words"),
        100 * F.col("n_capitals") > limits.capital_percent * F.col("n_chars"),
        F.col("n_symbols") > 0,
    )
    return sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails)), F.lit(0)).cast("int")


def outcomes(docs: DataFrame, labels: DataFrame, part: str, limits: Limits = Limits()) -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part by the set of filters that they fail, and how many of them are
    labelled good and toxic. ``docs`` has doc_id and text, ``labels`` has doc_id, quality and toxic.

    Copies of a text are counted together before they are shuffled by digest; a digest then has a row for each part and label,
    and the smallest id among these tells which of the copies is the first.
    """
    read = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "text")
    rows = measures(read, symbols=limits.symbols).select("id", "part", "digest", failures(limits).alias("mask"))
    rows = rows.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    of = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("l")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    # rows without an id meet no label: their digests spread them
    key = F.coalesce(F.col("id"), F.xxhash64("digest"))
    rows = rows.withColumns({"_k": key, "_none": F.col("id").isNull()}).join(of.withColumnRenamed("l", "_k").withColumn("_none", F.lit(False)), ["_k", "_none"], "left")
    rows = rows.select("id", "part", "digest", "mask", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("bad", F.lit(False)).alias("bad"))
    named = F.when(F.col("id").isNotNull(), F.col("n")).otherwise(0)
    sets = rows.groupBy("digest", "part", "mask", "good", "bad").agg(F.sum("n").alias("n"), F.sum(named).alias("named"), F.min("id").alias("low"), F.min_by("n", "id").alias("n_low"))
    first = F.min("low").over(W.partitionBy("digest"))
    again = F.col("named") - F.when(F.col("low") == F.col("first"), F.col("n_low")).otherwise(0)
    sets = sets.withColumn("first", first).withColumn("again", again)
    two = F.array(F.struct(F.col("mask"), (F.col("n") - F.col("again")).alias("n")), F.struct(F.col("mask").bitwiseOR(16).alias("mask"), F.col("again").alias("n")))
    each = sets.select("part", "good", "bad", F.inline(two))
    where = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), where("good").alias("good"), where("bad").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", limits: Limits = Limits()) -> DataFrame:
    """A row for each part, order of the filters and step: documents kept after the step, removed by it, failing its filter but
    removed before, failing its filter only, good and toxic ones removed by it, and ``shapley``: its filter's removals summed
    over all orders. A part has at most 32 sets of failures, so nothing larger than these meets the orders."""
    sets = outcomes(docs, labels, part, limits)
    parts = sets.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("s"))
    orders = ["".join(p) for p in permutations(FILTERS)]
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    table = json.dumps([{"filter_order": o, "step": i + 1, "own": bit[f], "before": sum(bit[g] for g in o[:i])} for o in orders for i, f in enumerate(o)])
    steps = parts.select("part", "s", F.inline(F.from_json(F.lit(table), "array<struct<filter_order: string, step: int, own: int, before: int>>")))

    def total(name: str, which, of=lambda s, v: v) -> Column:
        return F.aggregate(F.filter("s", which), F.lit(0).cast("long"), lambda a, s: a + of(s, s[name]))

    has = lambda s, bits: s["mask"].bitwiseAND(bits) != 0
    own, gone = F.col("own"), F.col("before")
    removed = lambda s: has(s, own) & ~has(s, gone)
    return steps.select(
        "part", "filter_order", "step",
        total("n", lambda s: ~has(s, own) & ~has(s, gone)).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda s: has(s, own) & has(s, gone)).alias("redundant"),
        total("n", lambda s: s["mask"] == own).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        # of the orders, one in as many as a document fails filters has this one first
        total("n", lambda s: has(s, own), lambda s, v: v * F.floor(len(orders) / F.bit_count(s["mask"]))).alias("shapley"),
    )
