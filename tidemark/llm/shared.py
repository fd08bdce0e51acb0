"""Shared folder for written tables, and vectorised tokenising of Arrow text columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# --- written tables ---------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a local session has none (tests), one is set; on a cluster that is an error, as machines don't share ``/tmp``.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
    return spark.sparkContext.getCheckpointDir()


class Scratch:
    """Tables written under one folder of the shared directory, so lineage ends there.

    A lost executor costs only a reread. ``drop`` removes a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/tidemark-{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        df.write.parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(conf).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores in front as it takes to begin no column of ``df``."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(name.lower()) for c in taken):
        name = f"_{name}"
    return name


# --- words of a text column ---------------------------------------------------

#: Bytes of text handled at once; a longer single text is hashed piece by piece.
CHUNK = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)


def _word_table(separators: bytes) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = _lower_table()
#: Words are runs without space, tab, line feed, vertical tab, form feed, carriage return.
BLANK_SEPARATED = _word_table(bytes([0x20, *range(0x09, 0x0E)]))
#: Words are runs of 0-9, a-z (after lower-casing) and everything outside ASCII.
ALNUM_RUNS = _word_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))

#: Words are runs of a-z (after lower-casing) and everything outside ASCII.
ALPHA_RUNS = _word_table(bytes([*range(0x00, 0x61), *range(0x7B, 0x80)]))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _P)


class _Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(int(_P), -1, 1 << 64)
            size = max(n, CHUNK + 4096)
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _P, dtype=np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(inverse), dtype=np.uint64)]), dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()


def span_hashes(low: np.ndarray, *spans: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """64-bit hashes of the byte spans ``[start, end)``; equal bytes give equal hashes.

    Every pair of sorted start and end arrays gives one array of hashes. The buffer is worked
    through in pieces of about ``CHUNK`` bytes, cut where the first pair's spans begin.
    """
    starts = spans[0][0]
    out: list[list[np.ndarray]] = [[] for _ in spans]
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        to = max(at + 1, int(np.searchsorted(starts, lo + CHUNK)))
        hi = max(int(e[at:to].max()) for _, e in spans)
        up, down = _POWERS.upto(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(_BYTE[low[lo:hi]] * up[: hi - lo], out=sums[1:])
        for k, (s, e) in enumerate(spans):
            s, e = s[at:to] - lo, e[at:to] - lo
            out[k].append(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)))
        at = to
    return [np.concatenate(x) if x else np.zeros(0, dtype=np.uint64) for x in out]


class Words:
    """Words of consecutive texts: byte spans, hashes, and the first word of each text."""

    def __init__(self, low: np.ndarray, offsets: np.ndarray, table: np.ndarray, hashed: bool = True) -> None:
        self.low, self.offsets = low, offsets
        inside = table[low]
        edge = np.zeros(len(low) + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(len(low), dtype=bool)
        after = np.empty(len(low), dtype=bool)
        if len(low):
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        #: Words of text i are first[i] to first[i + 1].
        self.first = np.searchsorted(self.start, offsets)
        self.hash = span_hashes(low, (self.start, self.end))[0] if hashed else None


def text_chunks(column: pa.Array, table: np.ndarray = LOWER) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes as ``table`` maps them, offsets) over a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        to = min(to, n)
        lo, hi = int(offsets[at]), int(offsets[to])
        yield at, to, table[raw[lo:hi]], offsets[at : to + 1] - lo
        at = to
