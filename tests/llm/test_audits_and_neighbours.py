"""Filter audit, divergence and nearest neighbours against plain Python, with the edges that their docstrings define."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.oracle import duck, same
from tidemark.llm import divergence, filter_audit, neighbours, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- filter audit --------------------------------------------------------------------


def py_measures(text):
    words = WORD.findall(text)
    return len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB é日 \t\n#|x" + chr(0) + chr(0x85) + "😀", max_size=60), min_size=1, max_size=8))
def test_the_pass_counts_like_regular_expressions(texts):
    raw = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    p = filter_audit.Pass(raw, offsets, filter_audit.byte_classes("#$%&*|"))
    owner = np.repeat(np.arange(len(texts)), np.diff(p.first))
    distinct = np.bincount(owner[filter_audit.SpanTable(raw, p.start, p.end, owner).distinct()], minlength=len(texts))
    got = list(zip(np.diff(p.first).tolist(), distinct.tolist(), p.capitals.tolist(), p.points.tolist(), p.symbols.tolist()))
    assert got == [py_measures(t) for t in texts]


def test_equal_hashes_of_different_words_stay_two(monkeypatch):
    monkeypatch.setattr(filter_audit, "mix", lambda x: x * np.uint64(0))
    long = "x" * 300
    words = ["ab", "ac", "ab", "abcdefgh", "abcdefgi", "abcdefghijklmnopqrs", "abcdefgh0jklmnopqrs", long + "a", long + "b", long + "a", "abc"]
    raw = np.frombuffer("".join(words).encode(), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in words])
    table = filter_audit.SpanTable(raw, ends - [len(w) for w in words], ends, np.zeros(len(words), dtype=np.int64))
    table.hash[:] = 7
    assert table.distinct().sum() == len(set(words))


def py_audit(docs, labels):
    low, masks = {}, []
    for i, text, _ in docs:
        if i is not None:
            low[text or ""] = min(low.get(text or "", i), i)
    good, bad = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    for i, text, part in docs:
        w, d, c, n, s = py_measures(text or "")
        fails = [w < 50, 100 * d < 65 * w, 100 * c > 5 * n, s > 0, i is not None and i > low[text or ""]]
        masks.append((part or "", sum(1 << k for k, f in enumerate(fails) if f), i in good and i is not None, i in bad and i is not None))
    out = {}
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        removed = Counter()
        for order in permutations("ABCDE"):
            gone = 0
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                out_ = [m for m in own if m[1] & bit and not m[1] & gone]
                removed[f] += len(out_)
                out[part, "".join(order), step] = [sum(not m[1] & (bit | gone) for m in own), len(out_), sum(bool(m[1] & bit and m[1] & gone) for m in own), sum(m[1] == bit for m in own), sum(m[2] for m in out_), sum(m[3] for m in out_)]
                gone |= bit
        for k in out:
            if k[0] == part:
                out[k].append(removed[k[1][k[2] - 1]])
    return out


def test_audit_equals_plain_python(spark):
    rng = random.Random(3)
    texts = ["", None, "word " * 60, "A" * 30 + " b", "x # y", "é" * 200 + " " + "z" * 100_000, " ".join(f"w{i}" for i in range(70)), " ".join(f"W{i}" for i in range(60)) + " |"]
    docs = [(i, rng.choice(texts), rng.choice(["a", "b", None, ""])) for i in range(150)]
    docs += [(3, "word " * 60, "a"), (3, "word " * 60, "a"), (None, "word " * 60, "b"), (None, None, None), (7, "x # y", "b")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1)]
    frame = spark.createDataFrame([(*d, "mine", 9) for d in docs], "doc_id long, text string, source string, part string, n_words int").repartition(3)
    found = filter_audit.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in found.collect()}
    assert got == py_audit(docs, labels)
    assert filter_audit.audit(frame.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


# --- divergence -----------------------------------------------------------------------


def py_divergence(docs, min_docs=3, top=200):
    n, in_docs, groups = Counter(), Counter(), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        for t in terms:
            n[lang, source, t] += 1
        for t in set(terms):
            in_docs[lang, t] += 1
    rows = []
    for lang, source in groups:
        kept = sorted(t for (x, t), d in in_docs.items() if x == lang and d >= min_docs)
        peers = [s for x, s in groups if x == lang]

        def share(members, t, kept=kept, lang=lang):
            count = lambda t: sum(n[lang, s, t] for s in members)
            return 1 + 10**9 * (count(t) + 1) // (sum(map(count, kept)) + len(kept))

        p = {t: share([source], t) for t in kept}
        f = lambda p, q: (p - q) ** 2 // q
        pairs = [(s, sum(f(p[t], share([s], t)) for t in kept)) for s in peers if s != source]
        terms = [(t, f(p[t], share(peers, t))) for t in kept if n[lang, source, t] and p[t] > share(peers, t)]
        for part, values, most in (("pair", pairs, None), ("term", terms, top)):
            values = sorted(values, key=lambda x: (-x[1], x[0].encode()))[:most]
            rows += [(lang, source, part, item, v, k) for k, (item, v) in enumerate(values, 1)]
    return sorted(rows)


def test_divergence_equals_plain_python(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 40)
    monkeypatch.setattr(divergence, "SCATTER", 7)
    monkeypatch.setattr(divergence, "GATHER", 30)
    monkeypatch.setattr(divergence, "HOLD", 20)
    rng = random.Random(4)
    words = ["the", "The", "été", "日本", "a1b", "o'c", "zz"] + [f"w{chr(97 + i)}" for i in range(15)]
    docs = [(" ".join(rng.choice(words) for _ in range(rng.randrange(0, 25))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "é", None])) for _ in range(60)]
    docs += [(None, "fr", "s1"), ("", "fr", "s2"), ("only once", "it", "s1"), docs[0], docs[0], ("x" * 50_000 + " the", "en", "s1")]
    frame = spark.createDataFrame([(*d, "mine", 1) for d in docs], "text string, lang string, source string, item string, n int").repartition(3)
    found = divergence.audit(frame, top=5)
    assert sorted(tuple(r) for r in found.collect()) == py_divergence(docs, top=5)
    assert divergence.audit(frame.limit(0)).count() == 0


def test_few_or_many_groups_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([("one two two", "en", "a"), ("one three", "en", "b"), ("one two", "en", "c")], "text string, lang string, source string")
    want = sorted(map(tuple, divergence.audit(docs).collect()))
    monkeypatch.setattr(divergence, "FEW_GROUPS", 0)
    assert sorted(map(tuple, divergence.audit(docs).collect())) == want and want


def test_shares_are_exact_for_large_counts(spark):
    rows = spark.createDataFrame([(7 * 10**14 + 3, 8 * 10**15 + 1), (0, 9), (0, 0), (8, 9)], "n long, total long")
    got = [r["p"] for r in divergence._share(rows, "p", "n", "total").collect()]
    assert got == [1 + 10**9 * (n + 1) // t if t else 1 for n, t in [(7 * 10**14 + 3, 8 * 10**15 + 1), (0, 9), (0, 0), (8, 9)]]


# --- nearest neighbours ------------------------------------------------------------------


def py_search(rows, k):
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            score = np.cumsum(x * np.array(v, dtype=np.float64), axis=1)[:, -1]
            best = sorted((-s, j) for s, j in zip(score.tolist(), ids) if j != i)[:k]
            out[i] = [(j, -s) for s, j in best]
    return out


def recall(got, want):
    return sum(len({j for j, _ in got.get(i, [])} & {j for j, _ in w}) for i, w in want.items()) / sum(len(w) for w in want.values())


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_all_rows_reranked_are_exact(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8)).astype(np.float32) * rng.uniform(0.1, 9, size=(400, 1)).astype(np.float32)
    x[50:150] = x[50]  # a third of all rows is one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1020, [0.0] * 8), (1040, [1.0] * 7 + [None]), (1060, [float("nan")] * 8), (1080, [float("inf")] + [1.0] * 7), (1100, [1.0, 2.0]), (None, [1.0] * 8), (1120, [])]
    frame = spark.createDataFrame([(i, v, "mine", 2) for i, v in rows + odd + rows[:30]], "vec_id long, embedding array<float>, id string, q int").repartition(4)
    asked = F.col("id") % 20 == 0
    got, want = answers(neighbours.search(frame, asked, share=1.0)), py_search(rows, 20)
    assert got == want
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>")
    assert answers(neighbours.search(few, asked)) == py_search(rows[:5], 20)
    one = spark.createDataFrame(rows[:1], "vec_id long, embedding array<float>")
    assert neighbours.search(one, asked).count() == 0
    none = neighbours.search(frame.limit(0), asked)
    assert none.count() == 0 and none.columns == ["query_id", "rank", "id", "score"]


@pytest.mark.parametrize("norms", [False, True])
def test_recall_on_rows_without_structure(spark, norms):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = (x * rng.uniform(0.5, 2, size=(6000, 1)) if norms else x).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = answers(neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 20 == 0))
    assert recall(got, py_search(rows, 20)) >= 0.95


def test_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = answers(queries.op13_neighbours(spark, sf).withColumnRenamed("vec_id", "id"))
    assert recall(got, py_search(rows, 20)) >= 0.95


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_divergence"])
def test_queries_equal_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    same(queries.QUERIES[name](spark, sf), duck(sf), queries.ORACLES[name])
