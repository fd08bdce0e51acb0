"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its hashed byte trigrams and 4-grams (letters and
spaces; ASCII lower-cased). Embeddings and softmax are trained by stochastic gradient descent in
numpy on a sample of about ``per_lang`` labelled rows a language (by hash of the id). A
temperature fitted on a fifth of the sample makes scores probabilities; ``reject_below`` is the
score under which at most one in a hundred right answers of that fifth falls.

Scoring covers whole texts. As the softmax is linear in the mean, embeddings times weights are
kept per bucket, so that a text costs one lookup and sum per n-gram.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import fresh, text_chunks

BUCKETS, DIM = 1 << 15, 16
#: Bound of the fit: about so many rows of each language.
PER_LANG = 500
GRAMS = (3, 4)
UNKNOWN = "und"

_SHAPE = np.full(256, 0x20, dtype=np.uint64)
_SHAPE[0x61:0x7B] = np.arange(0x61, 0x7B)
_SHAPE[0x80:] = np.arange(0x80, 0x100)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float
    reject_below: float


def _buckets(low: np.ndarray, offsets: np.ndarray):
    """(bucket, start) for each n: buckets at every byte, and where each text's n-grams begin and end."""
    shape = _SHAPE[low]
    for n in GRAMS:
        code = np.zeros(max(0, len(low) - n + 1), dtype=np.uint64)
        for i in range(n):
            code = (code << np.uint64(8)) | shape[i : len(low) - n + 1 + i]
        code = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)).astype(np.int64)
        yield code, np.minimum(offsets[:-1], len(code)), np.clip(offsets[1:] - n + 1, 0, len(code))


def _counts(batches):
    for batch in batches:
        for at, to, low, offsets in text_chunks(batch.column("_text")):
            parts = list(_buckets(low, offsets))
            ids, times = [], []
            for i in range(to - at):
                b, c = np.unique(np.concatenate([code[a[i] : max(a[i], z[i])] for code, a, z in parts]), return_counts=True)
                ids.append(b.astype(np.int32))
                times.append(c.astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column("_id_hash").slice(at, to - at), batch.column("_lang").slice(at, to - at), pa.array(ids, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.float32()))], ["_id_hash", "_lang", "ids", "times"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> Model:
    """Fits on rows with text and language; those without are left out. No rows: an empty model.

    The sample is drawn by a hash of id and text: about ``per_lang`` distinct ones of each language, and never over twice as many. So
    rows without an id are drawn by their texts, and rows repeated under one id count once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)).alias("_id_hash"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang")).where("_lang is not null and _text is not null")
    sizes = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.approx_count_distinct("_id_hash").alias("n")).collect()}  # as many as languages
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    shares = spark.createDataFrame([(lang, int(min(1.0, per_lang / n) * (1 << 30))) for lang, n in sizes.items()], "_lang string, _share long")
    picked = rows.join(F.broadcast(shares), "_lang").where(F.pmod("_id_hash", F.lit(1 << 30)) < F.col("_share"))
    picked = picked.groupBy("_lang", "_id_hash").agg(F.min("_text").alias("_text"))
    place = F.row_number().over(W.partitionBy("_lang").orderBy("_id_hash"))
    picked = picked.withColumn("_place", place).where(F.col("_place") <= 2 * per_lang).select("_id_hash", "_text", "_lang")
    got = picked.mapInArrow(_counts, "_id_hash long, _lang string, ids array<int>, times array<float>").toArrow()
    langs = sorted(sizes)
    order = np.argsort(got.column("_id_hash").to_numpy(), kind="stable")
    ids = [np.asarray(x) for x in got.column("ids").to_numpy()]
    times = [np.asarray(x) for x in got.column("times").to_numpy()]
    y = np.array([langs.index(x) for x in got.column("_lang").to_pylist()])
    use = [i for i in order if len(ids[i])]
    held, fit = use[::5], [i for k, i in enumerate(use) if k % 5]
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    weight, bias = rng.uniform(-0.5, 0.5, (DIM, len(langs))), np.zeros(len(langs))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(fit):
            x = times[i] / times[i].sum()
            h = x @ embed[ids[i]]
            off = _softmax(h @ weight + bias)
            off[y[i]] -= 1
            back = weight @ off
            weight -= step * np.outer(h, off)
            bias -= step * 0.1 * off
            embed[ids[i]] -= step * 20 * x[:, None] * back
    table = embed @ weight
    temperature, reject = 1.0, 0.0
    if held:
        z = np.array([(times[i] / times[i].sum()) @ table[ids[i]] + bias for i in held])
        t = y[held]
        # smoothed targets: without an error in the held fifth, sharper would always look better
        sure = (len(t) + 1) / (len(t) + 2)
        loss = {}
        for k in np.geomspace(0.02, 5, 60):
            right = _softmax(z / k)[np.arange(len(t)), t]
            loss[k] = -(sure * np.log(right + 1e-12) + (1 - sure) * np.log(1 - right + 1e-12)).mean()
        temperature = float(min(loss, key=loss.get))
        p = _softmax(z / temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == t]
        reject = float(np.quantile(right, 0.01)) if len(right) else 0.0
    return Model(langs, table, bias, temperature, reject)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows with ``lang_pred``, ``score`` and ``rejected`` (score under the calibrated bound).

    A null text, a text without letters and an empty model give ``und``, score 0 and rejected.
    Texts too short for an n-gram are scored by the bias. Rows are neither dropped nor joined;
    columns named like the three new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "rejected")]
    letters = fresh(docs, "_letters")

    def run(batches):
        m = shared.value
        # one more row of zeros, for sums over no n-grams; one column more than sums, for counts
        for batch in batches:
            n, langs = batch.num_rows, len(m.langs)
            z = np.zeros((n, langs))
            total = np.zeros(n)
            for at, to, low, offsets in text_chunks(batch.column(text_col)) if langs else ():
                for code, a, b in _buckets(low, offsets):
                    some = np.flatnonzero(b > a)
                    if not len(some):
                        continue
                    # sums from a to b: reduceat over interleaved bounds, of which every other is wanted
                    bounds = np.stack([a[some], b[some]], axis=1).ravel()
                    last = bounds[-1] == len(code)
                    for k in range(langs):
                        v = m.table[:, k].astype(np.float32)[code].astype(np.float64)
                        z[at + some, k] += np.add.reduceat(v, bounds[:-1] if last else bounds)[::2]
                    total[at + some] += (b - a)[some]
            has = batch.column(letters).fill_null(False).to_numpy(zero_copy_only=False) & (langs > 0)
            if langs:
                p = _softmax((z / np.maximum(total, 1)[:, None] + m.bias) / m.temperature)
                best, score = p.argmax(axis=1), p.max(axis=1)
            else:
                best, score = np.zeros(n, dtype=np.int64), np.zeros(n)
            names = np.array([*m.langs, UNKNOWN], dtype=object)
            pred = names[np.where(has, best, langs)]
            score = np.where(has, np.clip(score, 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(pred, pa.string()), pa.array(score), pa.array(~has | (score < m.reject_below))], [*kept, "lang_pred", "score", "rejected"])

    own = docs.select(*kept)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return own.withColumn(letters, F.col(text_col).rlike(r"\p{L}")).mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")
