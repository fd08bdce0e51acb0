"""Benchmark decontamination by winnowing.

Words are runs of digits, ASCII letters (lower-cased) and all characters outside ASCII. Of every
``window - gram + 1`` consecutive ``gram``-word hashes the smallest is kept, so a document and an
item that share ``window`` consecutive words share a kept fingerprint. Test and training
fingerprints are joined on the hash; each match is extended word by word in both directions, and
runs of at least ``window`` words are hits. An item of fewer words is one window: its whole
sequence is its only fingerprint, looked up among all sequences of that length.

The join has two forms with one result. Test sets of at most ``broadcast_bytes`` of text (the
size is measured first) go to every task and are probed where the documents are read. Larger
ones are joined on the hash by a shuffle; only (text, item) pairs that share a fingerprint are
brought together for the extension.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ALNUM_RUNS, Words, mix, text_chunks

WINDOW, GRAM = 10, 5
#: Text bytes of a test set up to which it is broadcast.
BROADCAST_BYTES = 32 << 20
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all sequences of ``k`` words."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = mix((out + words[i : i + n]) * _STEP[i % 64])
    return out


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the smallest hash (ties: all) of some window of ``width`` hashes."""
    n = len(hashes)
    if width <= 1 or n <= width:
        return np.flatnonzero(hashes == hashes.min()) if n and width > 1 else np.arange(n)
    m = n - width + 1
    low = hashes[:m].copy()
    for i in range(1, width):
        np.minimum(low, hashes[i : i + m], out=low)
    high = np.zeros(n, dtype=np.uint64)  # of the windows over a position, the largest minimum
    for i in range(width):
        np.maximum(high[i : i + m], low, out=high[i : i + m])
    return np.flatnonzero(high == hashes)


class Index:
    """Fingerprints of test items, by hash, and the items' words for the extension."""

    def __init__(self, names: list[str], words: list[np.ndarray], window: int, gram: int) -> None:
        self.window, self.gram, self.names, self.words = window, gram, names, words
        hashes, item, pos = [], [], []
        self.short = sorted({len(w) for w in words if 0 < len(w) < window})
        for i, w in enumerate(words):
            if len(w) >= window:
                g = grams(w, gram)
                at = winnow(g, window - gram + 1)
                h = g[at]
            else:
                h = grams(w, len(w)) if len(w) else np.zeros(0, dtype=np.uint64)
                h, at = mix(h + np.uint64(len(w))), np.zeros(len(h), dtype=np.int64)
            hashes.append(h)
            item.append(np.full(len(h), i))
            pos.append(at)
        flat = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hash = flat[order]
        self.item = (np.concatenate(item) if item else np.zeros(0, dtype=np.int64))[order]
        self.pos = (np.concatenate(pos) if pos else np.zeros(0, dtype=np.int64))[order]
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(self.hash & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes the index holds."""
        maybe = np.flatnonzero(self.seen[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.searchsorted(self.hash, hashes[maybe])
        ok = at < len(self.hash)
        ok[ok] = self.hash[at[ok]] == hashes[maybe[ok]]
        return maybe[ok]


def fingerprints(words: np.ndarray, first: np.ndarray, window: int, gram: int, short: list[int]):
    """(positions, hashes, length) of the fingerprints of consecutive texts; text i starts at word first[i]."""
    def within(k):  # sequences of k words that stay in one text
        g = grams(words, k)
        ok = np.ones(len(g), dtype=bool)
        for i in range(1, k):
            cut = first - i
            cut = cut[(cut >= 0) & (cut < len(g))]
            ok[cut] = False
        return g, ok

    g, ok = within(gram)
    g = np.where(ok, g, _NONE)
    at = winnow(g, window - gram + 1)
    at = at[g[at] != _NONE]
    yield at, g[at], gram
    for k in short:
        g, ok = within(k)
        at = np.flatnonzero(ok)
        yield at, mix(g[at] + np.uint64(k)), k


def hits(index: Index, words: np.ndarray, first: np.ndarray) -> dict[int, tuple[list[tuple[int, int]], set[int]]]:
    """By number of the text: spans of hit words (from the text's start) and items with an occurring window."""
    found: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
    reach: dict[tuple[int, int], int] = {}  # (item, shift): words before this are extended already
    for at, hashes, k in fingerprints(words, first, index.window, index.gram, index.short):
        for j in index.lookup(hashes):
            p = int(at[j])
            text = int(np.searchsorted(first, p, side="right")) - 1
            lo, hi = int(first[text]), int(first[text + 1])
            r = int(np.searchsorted(index.hash, hashes[j]))
            while r < len(index.hash) and index.hash[r] == hashes[j]:
                item, q = int(index.item[r]), int(index.pos[r])
                r += 1
                target = index.words[item]
                full = len(target) >= index.window
                if full != (k == index.gram) and len(target) != k:
                    continue
                if reach.get((item, p - q), -1) > p:
                    continue
                a, b = _extend(words, lo, hi, p, target, q)
                reach[(item, p - q)] = max(b, p + 1)
                if b - a >= min(index.window, len(target)):
                    spans, items = found.setdefault(text, ([], set()))
                    spans.append((a - lo, b - lo))
                    items.add(item)
    return found


def _extend(words, lo, hi, p, target, q) -> tuple[int, int]:
    """The longest run of equal words through document word p and item word q."""
    n = min(p - lo, q)
    left = np.flatnonzero(words[p - n : p][::-1] != target[q - n : q][::-1])
    a = p - (int(left[0]) if len(left) else n)
    m = min(hi - p, len(target) - q)
    right = np.flatnonzero(words[p : p + m] != target[q : q + m])
    b = p + (int(right[0]) if len(right) else m)
    return a, b


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RESULT = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def _probe(shared):
    def run(batches):
        index = shared.value
        for batch in batches:
            text = batch.column("_text")
            count, spans, items = [], [], []
            for at, to, low, offsets in text_chunks(text):
                w = Words(low, offsets, ALNUM_RUNS)
                found = hits(index, w.hash, w.first)
                count.append(np.diff(w.first))
                for i in range(to - at):
                    s, n = found.get(i, ((), ()))
                    spans.append([{"start": a, "end": b} for a, b in _merged(s)])
                    items.append(sorted({index.names[x] for x in n}) if n else [])
            rest = [batch.column(c) for c in batch.schema.names if c != "_text"]
            names = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(np.concatenate(count) if count else [], pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], [*names, "n_words", "spans", "items"]
            )

    return run


def _words_of(batches):
    for batch in batches:
        out = []
        for at, to, low, offsets in text_chunks(batch.column("_text")):
            w = Words(low, offsets, ALNUM_RUNS)
            out += [w.hash[w.first[i] : w.first[i + 1]].tobytes() for i in range(to - at)]
        yield pa.RecordBatch.from_arrays([batch.column("_item"), pa.array(out, pa.binary())], ["_item", "_words"])


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    broadcast_bytes: int = BROADCAST_BYTES,
    carry: bool = False,
) -> DataFrame:
    """One row per document row: id, ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted ids as
    strings), ``spans`` (word ranges of the hits, end exclusive), ``contaminated``.

    ``carry=True`` adds the whole input row as the struct ``row``.

    Null and blank texts have no words and no hits. Items without an id are left out of ``items``
    only if their text has no words; their id reads ``null``. Repeated items with one id count
    once. Repeated document rows give repeated result rows. Empty tables on either side work;
    other columns are ignored.
    """
    spark = docs.sparkSession
    more = [F.struct(*docs.columns).alias("row")] if carry else []
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *more)
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("_item"), F.col(item_text_col).alias("_text")).where("_text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)).alias("n")).first()["n"]
    words = items.mapInArrow(_words_of, "_item string, _words binary").where(F.octet_length("_words") > 0)
    if size <= broadcast_bytes:
        rows = words.toArrow().to_pydict()
        index = Index(rows["_item"], [np.frombuffer(x, dtype=np.uint64) for x in rows["_words"]], window, gram)
        kept = ", ".join(f"{name} {kind}" for name, kind in src.dtypes if name != "_text")
        out = src.mapInArrow(_probe(spark.sparkContext.broadcast(index)), f"{kept}, {_RESULT}")
    else:
        out = _by_shuffle(src, words, window, gram)
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(F.col("_id").alias(id_col), "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans", (covered > 0).alias("contaminated"), *(["row"] if carry else []))


def _by_shuffle(src: DataFrame, words: DataFrame, window: int, gram: int) -> DataFrame:
    """The same for test sets of any size; equal texts are handled once."""

    def doc_prints(lengths):
        def run(batches):
            for batch in batches:
                row = 0
                for at, to, low, offsets in text_chunks(batch.column("_text")):
                    w = Words(low, offsets, ALNUM_RUNS)
                    for pos, hashes, _ in fingerprints(w.hash, w.first, window, gram, lengths):
                        text = np.searchsorted(w.first, pos, side="right") - 1
                        both = np.unique(np.stack([text, hashes.view(np.int64)], axis=1), axis=0)
                        yield pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array(both[:, 0] + row)), pa.array(both[:, 1])], ["_key", "_print"])
                    row += to - at

        return run

    def item_prints(batches):
        for batch in batches:
            for name, raw in zip(batch.column("_item").to_pylist(), batch.column("_words").to_pylist(), strict=True):
                one = Index([name], [np.frombuffer(raw, dtype=np.uint64)], window, gram)
                h = np.unique(one.hash).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(h)), pa.array([raw] * len(h), pa.binary()), pa.array(h)], ["_item", "_words", "_print"])

    def pair_hits(batches):
        for batch in batches:
            keys, spans, names = [], [], []
            for key, text, item, raw in zip(*(batch.column(c) for c in ("_key", "_text", "_item", "_words")), strict=True):
                index = Index([item.as_py()], [np.frombuffer(raw.as_py(), dtype=np.uint64)], window, gram)
                for _, _, low, offsets in text_chunks(pa.array([text.as_py()])):
                    w = Words(low, offsets, ALNUM_RUNS)
                    for s, _ in hits(index, w.hash, w.first).values():
                        keys.append(key.as_py())
                        spans.append([{"start": a, "end": b} for a, b in _merged(s)])
                        names.append(item.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(spans, _SPANS), pa.array(names, pa.string())], ["_key", "_spans", "_item"])

    def count_words(batches):
        for batch in batches:
            n = [np.diff(Words(low, offsets, ALNUM_RUNS, hashed=False).first) for _, _, low, offsets in text_chunks(batch.column("_text"))]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(np.concatenate(n) if n else [], pa.int64())], ["_key", "n_words"])

    keyed = src.withColumn("_key", F.sha2(F.coalesce("_text", F.lit("")), 256))
    texts = keyed.groupBy("_key").agg(F.first("_text").alias("_text"))
    lengths = [r["n"] for r in words.select((F.octet_length("_words") / 8).cast("int").alias("n")).where(F.col("n") < window).distinct().collect()]  # under window values
    prints = texts.mapInArrow(doc_prints(sorted(lengths)), "_key string, _print long")
    item = words.mapInArrow(item_prints, "_item string, _words binary, _print long")
    pairs = prints.join(item, "_print").select("_key", "_item", "_words").distinct()
    found = texts.join(pairs, "_key").select("_key", "_text", "_item", "_words").mapInArrow(pair_hits, "_key string, _spans array<struct<start:long,end:long>>, _item string")
    byte = found.groupBy("_key").agg(F.flatten(F.collect_list("_spans")).alias("s"), F.array_sort(F.collect_set("_item")).alias("items"))
    merge = """aggregate(array_sort(s), cast(array() as array<struct<start:bigint,end:bigint>>), (acc, x) ->
        if(size(acc) > 0 and x.start <= element_at(acc, -1).end,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end)))),
           concat(acc, array(x))))"""
    byte = byte.select("_key", F.expr(merge).alias("spans"), "items")
    n = texts.mapInArrow(count_words, "_key string, n_words long")
    both = keyed.drop("_text").join(n, "_key").join(byte, "_key", "left")
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    return both.select("_id", *(c for c in src.columns if c == "row"), "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))
