"""Secret scans: pattern matches, and random-looking strings by character Markov models.

Three kinds come from patterns: ``assign`` (a value given to a password, secret, token or key),
``access`` (access key ids) and ``hex`` (32 hex digits or more). The fourth, ``random``, takes runs
of ``MIN_RUN`` or more key characters that no pattern span touches, and compares two first-order
Markov models over characters, one of random strings and one of ordinary identifiers, by the mean
log-likelihood ratio of the run's transitions.

The models are trained from labelled samples: random are the values that the patterns find in at most ``sample_docs``
texts (of so many hash buckets each the text of smallest hash) and ``sample_keys`` strings drawn from hashes in four common
alphabets; ordinary are the other words of those texts. Three fifths of the distinct strings (by hash) are
counted; on another fifth the ratio is chosen from which a run counts as random, and on the last both rates of
the model are measured. Counts are DataFrame aggregates; only tables as large as the alphabet squared, and histograms
of ratios, reach the driver. Everything runs on built-in functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, fresh

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs that fail the length would fail with any shorter start as well, so the length is part of these two.
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE, MIN_RUN = 8, 20
RUN = r"[A-Za-z0-9+/_=-]{%d,}"
#: Where the held-out strings don't tell: the mean log-likelihood ratio from which a run counts as random.
MIN_RATIO = 0.7
#: Width of a histogram cell of ratios; characters from which a string is long enough to be judged; the cost of a false alarm in misses.
CELL, MIN_JUDGED, ALARM_COST = 0.05, 16, 4.0
#: Bounds of the training samples.
SAMPLE_DOCS, SAMPLE_KEYS = 2_000, 4_000
#: Characters of the models; any other is the last state.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=.-"
STATES = len(ALPHABET) + 1
#: A noncharacter that marks matches; in a text it is first replaced by the replacement character.
_MARK = "﷐"
_SPAN = "array<struct<start:int,end:int,kind:int,value:string>>"


def _marked(text: Column, pattern: str, kind: int) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points; none for most texts."""
    parts = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.expr(f"cast(array() as {_SPAN})").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        one = F.struct(acc["at"].alias("start"), end.alias("end"), F.lit(kind).alias("kind"), part.alias("value"))
        return F.struct((acc["i"] + 1).alias("i"), end.alias("at"), F.when(acc["i"] % 2 == 1, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(parts, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.expr(f"cast(array() as {_SPAN})"))


def base_spans(text: Column) -> Column:
    """Pattern spans by start, then kind."""
    text = F.translate(F.coalesce(text, F.lit("")), _MARK, "�")
    assign = F.filter(_marked(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= MIN_VALUE)
    spans = F.concat(assign, _marked(text, ACCESS, 1), _marked(text, HEX, 2))
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"))))


def _transitions(words: DataFrame) -> DataFrame:
    """(label, from, to, n) over the column ``word``; ``from`` -1 is the start."""
    chars = words.select(F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i"), "word", "n", "label")
    cur = F.expr(f"coalesce(nullif(instr('{ALPHABET}', substring(word, i, 1)), 0), {STATES}) - 1")
    prev = F.expr(f"if(i = 1, -1, coalesce(nullif(instr('{ALPHABET}', substring(word, i - 1, 1)), 0), {STATES}) - 1)")
    return chars.select("label", prev.alias("a"), cur.alias("b"), "n").groupBy("label", "a", "b").agg(F.sum("n").alias("n"))


def _random_keys(spark: SparkSession, n: int) -> DataFrame:
    """Strings over four alphabets, drawn from hashes of a counter."""
    raw = F.concat(F.sha2(F.concat(F.lit("a"), F.col("id").cast("string")), 256), F.sha2(F.concat(F.lit("b"), F.col("id").cast("string")), 256))
    b64 = F.base64(F.unhex(raw))
    form = F.when(F.col("id") % 4 == 0, F.substring(raw, 1, 40)).when(F.col("id") % 4 == 1, F.substring(b64, 1, 40)).when(F.col("id") % 4 == 2, F.substring(F.regexp_replace(b64, "[+/=]", ""), 1, 32)).otherwise(F.substring(F.upper(F.regexp_replace(b64, "[+/=]", "")), 1, 24))
    return spark.range(n).select(form.alias("word"))


@dataclass
class Model:
    """``ratios``: log-likelihood ratios (random over ordinary) by transition, ``(from + 1) * STATES + to``; ``min_ratio``: the mean from
    which a run counts as random; ``recall`` and ``false_alarms``: shares of held-out random and ordinary strings at or
    over it (None without any)."""

    ratios: list[float]
    min_ratio: float
    recall: float | None
    false_alarms: float | None


def _sample(docs: DataFrame, text_col: str, n: int) -> DataFrame:
    """At most ``n`` distinct texts: of each of ``n`` buckets of hashes the one with the smallest hash, found on hashes alone."""
    texts = docs.select(F.col(text_col).alias("t")).where("t is not null").withColumn("h", F.xxhash64("t"))
    least = texts.groupBy(F.pmod("h", F.lit(n)).alias("b")).agg(F.min("h").alias("h")).select("h")
    picked = texts.join(F.broadcast(least), "h").groupBy("h").agg(F.first("t").alias("t")).select("t")
    # written before any span is taken, so that no filter on spans moves to the scan of all texts
    return Scratch(docs.sparkSession, "secrets").save(picked, "sample")


def train(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_keys: int = SAMPLE_KEYS) -> Model:
    """Texts of the sample may be null or empty; without any, ordinary is uniform."""
    spark = docs.sparkSession
    sample = _sample(docs, text_col, sample_docs).withColumn("s", base_spans(F.col("t")))
    found = sample.select(F.explode("s").alias("s")).select(F.when(F.col("s.kind") == 0, F.regexp_extract("s.value", ASSIGN, 2)).otherwise(F.col("s.value")).alias("word"))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = sample.select(F.explode(F.regexp_extract_all(bare, F.lit("([A-Za-z0-9+/_.=-]{4,})"), 1)).alias("word"))
    both = found.unionByName(_random_keys(spark, sample_keys).select("word")).withColumn("label", F.lit("random")).unionByName(words.withColumn("label", F.lit("ordinary")))
    fold = F.pmod(F.xxhash64("word", F.lit(5)), F.lit(5))
    labelled = Scratch(spark, "secrets").save(both.groupBy("word", "label").agg(F.count("*").alias("n")).withColumn("fold", fold), "strings")
    counts = _transitions(labelled.where("fold > 1")).collect()  # 2 * STATES * (STATES + 1) rows at most
    table = {"random": [[0.5] * STATES for _ in range(STATES + 1)], "ordinary": [[0.5] * STATES for _ in range(STATES + 1)]}
    for r in counts:
        table[r["label"]][r["a"] + 1][r["b"]] += r["n"]
    ratios = []
    for a in range(STATES + 1):
        x, y = table["random"][a], table["ordinary"][a]
        ratios += [math.log(x[b] / sum(x)) - math.log(y[b] / sum(y)) for b in range(STATES)]
    # distinct strings count once: a common word is no more of a false alarm than a rare one
    judged = labelled.where((F.col("fold") < 2) & (F.length("word") >= MIN_JUDGED)).select("fold", "label", F.floor(_ratio(ratios, F.col("word")) / CELL).alias("cell"))
    cells = judged.groupBy("fold", "label", "cell").agg(F.count("*").alias("n")).collect()

    def over(fold: int, label: str, cell: int) -> float | None:
        mine = [(r["cell"], r["n"]) for r in cells if r["fold"] == fold and r["label"] == label]
        return sum(n for c, n in mine if c >= cell) / sum(n for _, n in mine) if mine else None

    steps = sorted({r["cell"] for r in cells if r["fold"] == 0})
    if over(0, "random", 0) is None or over(0, "ordinary", 0) is None:
        cut = round(MIN_RATIO / CELL)
    else:  # of equally good ratios the middle one
        gain = {c: over(0, "random", c) - ALARM_COST * over(0, "ordinary", c) for c in range(steps[0], steps[-1] + 2)}
        best = [c for c in gain if gain[c] >= max(gain.values()) - 1e-12]
        cut = best[len(best) // 2]
    return Model(ratios, cut * CELL, over(1, "random", cut), over(1, "ordinary", cut))


def _ratio(model: list[float], word: Column) -> Column:
    """Mean log-likelihood ratio of a word's transitions."""
    table = F.split(F.lit(",".join(f"{x:.3f}" for x in model)), ",").cast("array<double>")
    state = lambda c: F.coalesce(F.nullif(F.call_function("instr", F.lit(ALPHABET), c), F.lit(0)), F.lit(STATES)) - 1
    chars = F.split(word, "")
    start = F.struct(F.lit(-1).alias("a"), F.lit(0.0).cast("double").alias("sum"))

    def step(acc: Column, c: Column) -> Column:
        return F.struct(state(c).alias("a"), (acc["sum"] + F.get(table, (acc["a"] + 1) * STATES + state(c))).alias("sum"))

    return F.aggregate(chars, start, step, lambda acc: acc["sum"]) / F.length(word)


def scan(docs: DataFrame, model: Model, text_col: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """The rows with ``secrets``: an array of (start, kind, end, value), by start, then kind.

    Kinds are numbers in ``KINDS``; positions are code points, end exclusive. Null and empty texts
    have none. No shuffle; repeated rows stay. A column named ``secrets`` is replaced.
    """
    kept = [c for c in docs.columns if c.lower() != "secrets"]
    base = fresh(docs, "_base")
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), _MARK, "�")
    runs = F.filter(_marked(text, RUN % min_run, 3), lambda s: _ratio(model.ratios, s["value"]) >= model.min_ratio)
    apart = F.filter(runs, lambda s: ~F.exists(F.col(base), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    more = F.transform(apart, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    out = docs.select(*kept, base_spans(F.col(text_col)).alias(base))
    return out.select(*kept, F.array_sort(F.concat(base, more)).alias("secrets"))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
