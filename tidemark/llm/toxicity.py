"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

``P(grade > k) = sigmoid(w.x - theta[k])`` with one weight vector for all thresholds, so the
thresholds are ordered and share the weights. Features of a text are its distinct words and word
prefixes of four to seven bytes that told grades apart in the labelled sample, for or against a higher grade. Expected
severity is the sum of ``P(grade > k)`` over k. Grades are those of the labels; two of them give one threshold.

The fit reads at most ``max_rows`` labelled ids (those with the smallest hash of the id), one text each, written
once. Document frequencies by grade are counted in Spark; at most ``max_features`` of them, and their occurrences
in the sample, reach the driver. Scoring covers every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ALNUM_RUNS, Scratch, Words, span_hashes, text_chunks

PREFIXES = (4, 5, 6, 7)
#: Bounds of the fit: labelled rows, and features kept.
MAX_ROWS, MAX_FEATURES = 20_000, 2_000
#: A feature is kept if it is in so many sample texts at least.
MIN_DOCS = 4
#: Grades at most; odds by which a feature must tell texts over a threshold from those under it; how much less evidence against counts.
MAX_GRADES, ODDS, AGAINST = 16, 10.0, 0.5
#: Power by which a grade's rarity weighs in the fit.
BALANCE = 0.25
#: Expected severity from which a text counts as toxic.
CUT = 0.5
_MASK = (1 << 20) - 1


@dataclass
class Model:
    """Sorted feature hashes, their weights, and the ordered thresholds."""

    hashes: np.ndarray
    weights: np.ndarray
    theta: np.ndarray

    def exceed(self, evidence: np.ndarray) -> np.ndarray:
        """P(grade > k) for all k, by row."""
        return 1 / (1 + np.exp(np.clip(self.theta[None, :] - evidence[:, None], -50, 50)))


def _features(low: np.ndarray, offsets: np.ndarray):
    """(text number, feature hash) of all words and prefixes."""
    w = Words(low, offsets, ALNUM_RUNS, hashed=False)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(w.first))
    spans = [(w.start, w.end)] + [(w.start, np.minimum(w.start + p, w.end)) for p in PREFIXES]
    found = span_hashes(low, *spans)
    yield text, found[0]
    for p, h in zip(PREFIXES, found[1:], strict=True):
        long = w.end - w.start > p
        yield text[long], h[long] ^ np.uint64(p)  # a prefix is another feature than the same word


class Lookup:
    """Which hashes are features of the model, and which."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes
        self.seen = np.zeros(_MASK + 1, dtype=bool)
        self.seen[(hashes & np.uint64(_MASK)).astype(np.int64)] = True

    def __call__(self, text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        maybe = np.flatnonzero(self.seen[(hashes & np.uint64(_MASK)).astype(np.int64)])
        at = np.searchsorted(self.hashes, hashes[maybe])
        ok = at < len(self.hashes)
        ok[ok] = self.hashes[at[ok]] == hashes[maybe[ok]]
        return text[maybe[ok]], at[ok]


def _present(column, lookup: Lookup):
    """(text number, feature number) pairs, each once."""
    for at, to, low, offsets in text_chunks(column):
        found = [lookup(*x) for x in _features(low, offsets)]
        text, feature = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        both = np.unique(text * np.int64(max(1, len(lookup.hashes))) + feature)
        yield at, to, both // max(1, len(lookup.hashes)), both % max(1, len(lookup.hashes))


def _frequencies(levels: int):
    """By feature the number of texts of each grade, for every chunk of texts that a task reads."""

    def run(batches):
        for batch in batches:
            grade = batch.column("_grade").to_numpy()
            for at, to, low, offsets in text_chunks(batch.column("_text")):
                text, hashes = (np.concatenate(x) for x in zip(*_features(low, offsets), strict=True))
                both = np.unique(np.stack([text.astype(np.uint64), hashes]), axis=1) if len(text) else np.zeros((2, 0), dtype=np.uint64)
                names, where = np.unique(both[1], return_inverse=True)
                own = grade[at:to][both[0].astype(np.int64)]
                counts = np.bincount(where * levels + own, minlength=len(names) * levels).reshape(-1, levels)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), *(pa.array(counts[:, k]) for k in range(levels))], ["h", *(f"n{k}" for k in range(levels))])

    return run


def _ordinal(rows: list[np.ndarray], grade: np.ndarray, n: int, levels: int, rounds: int = 400, rate: float = 0.2, shrink: float = 1e-4):
    """Weights and thresholds by gradient ascent (Adam) on the likelihood of all cumulative splits."""
    w, theta = np.zeros(n), np.linspace(1, 2, levels - 1)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.concatenate(rows) if len(doc) else np.zeros(0, dtype=np.int64)
    above = grade[:, None] > np.arange(levels - 1)[None, :]
    # rare grades count for more, by the root of how rare they are
    weight = (len(rows) / np.maximum(1, np.bincount(grade, minlength=levels)))[grade] ** BALANCE
    state = [np.zeros(n + levels - 1), np.zeros(n + levels - 1)]
    for k in range(1, rounds + 1):
        evidence = np.bincount(doc, weights=w[feature], minlength=len(rows))
        p = 1 / (1 + np.exp(np.clip(theta[None, :] - evidence[:, None], -50, 50)))
        off = (p - above) * weight[:, None]
        grad = np.concatenate([np.bincount(feature, weights=off.sum(axis=1)[doc], minlength=n), -off.sum(axis=0)]) / max(1.0, weight.sum())
        grad[:n] += shrink * w
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        step = rate * (state[0] / (1 - 0.9**k)) / (np.sqrt(state[1] / (1 - 0.99**k)) + 1e-8)
        w = w - step[:n]
        theta = np.sort(theta - step[n:])
    return w, theta


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "toxic", max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> Model:
    """Fits grades 0, 1, 2, ... in ``grade_col``. Null grades, ids and texts are left out (a negative grade is 0); of several grades of an id
    the highest counts, of several texts the first in order. Without labelled texts of two grades the model finds nothing toxic."""
    spark = docs.sparkSession
    given = labels.select(F.col(id_col).alias("_id"), F.greatest(F.col(grade_col).cast("int"), F.lit(0)).alias("_grade")).where(F.col(id_col).isNotNull() & F.col(grade_col).isNotNull())
    given = given.groupBy("_id").agg(F.max("_grade").alias("_grade")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    chosen = spark.createDataFrame(given.toArrow())  # at most max_rows ids and grades
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null").join(F.broadcast(chosen), "_id")
    sample = Scratch(spark, "toxic").save(texts.groupBy("_id", "_grade").agg(F.min("_text").alias("_text")).select("_text", "_grade"), "sample")
    empty = Model(np.zeros(0, dtype=np.uint64), np.zeros(0), np.array([30.0]))
    size = {r["_grade"]: r["n"] for r in sample.groupBy("_grade").agg(F.count("*").alias("n")).collect()}  # as many as grades
    if len(size) < 2:
        return empty
    levels = max(size) + 1
    if levels > MAX_GRADES:
        raise ValueError(f"grades must be under {MAX_GRADES}")
    names = [f"n{k}" for k in range(levels)]
    by = sample.mapInArrow(_frequencies(levels), "h long, " + ", ".join(f"{n} long" for n in names)).groupBy("h").agg(*(F.sum(n).alias(n) for n in names))
    # over some threshold, texts must hold the feature ten times as often as under it, or the other way round, by a smoothed rate
    scores = []
    for k in range(levels - 1):
        over, under = sum(F.col(n) for n in names[k + 1 :]), sum(F.col(n) for n in names[: k + 1])
        all_over, all_under = sum(v for g, v in size.items() if g > k), sum(v for g, v in size.items() if g <= k)
        odds = F.log((over + 0.5) / (all_over + 1.0)) - F.log((under + 0.5) / (all_under + 1.0))
        scores.append(F.when((odds >= float(np.log(ODDS))) & (over >= MIN_DOCS), odds * F.sqrt(over)).when((odds <= -float(np.log(ODDS))) & (under >= MIN_DOCS), -odds * F.sqrt(under) * AGAINST))
    best = by.select("h", F.greatest(*scores, F.lit(0.0)).alias("score")).where("score > 0").orderBy(F.desc("score"), "h").limit(max_features).toPandas()
    if not len(best):
        return empty
    hashes = np.sort(best["h"].to_numpy().astype(np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast(hashes)

    def present(batches):
        lookup = Lookup(shared.value)
        for batch in batches:
            for at, to, text, feature in _present(batch.column("_text"), lookup):
                bounds = np.searchsorted(text, np.arange(to - at + 1))
                yield pa.RecordBatch.from_arrays([pa.array([feature[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], pa.list_(pa.int64())), batch.column("_grade").slice(at, to - at)], ["f", "_grade"])

    rows = sample.mapInArrow(present, "f array<long>, _grade int").toPandas()
    marks = [np.array(f, dtype=np.int64) for f in rows["f"]]
    w, theta = _ordinal(marks, rows["_grade"].to_numpy().astype(np.int64), len(hashes), levels)
    return Model(hashes, w, theta)


def grade(docs: DataFrame, model: Model, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows with ``severity`` (expected grade), ``grade`` (most likely) and ``toxic``.

    Null and empty texts have no features, so the model's grade for no evidence. Rows are neither
    dropped nor joined; repeated rows stay. Columns named like the three new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() not in ("severity", "grade", "toxic")]

    def run(batches):
        m = shared.value
        lookup = Lookup(m.hashes)
        for batch in batches:
            evidence = np.zeros(batch.num_rows)
            for at, to, text, feature in _present(batch.column(text_col), lookup):
                evidence[at:to] = np.bincount(text, weights=m.weights[feature], minlength=to - at)
            p = m.exceed(evidence)
            each = np.concatenate([np.ones((len(p), 1)), p], axis=1) - np.concatenate([p, np.zeros((len(p), 1))], axis=1)
            severity = p.sum(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(severity), pa.array(each.argmax(axis=1)), pa.array(severity >= cut)], [*kept, "severity", "grade", "toxic"])

    own = docs.select(*kept)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return own.mapInArrow(run, f"{schema}, severity double, grade long, toxic boolean")
