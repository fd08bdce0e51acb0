"""Winnowing in both forms of the join against brute force."""

import random
import re

import numpy as np
import pytest

from tidemark.llm import decontaminate as D


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, n=10):
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, bt in items:
            b = words(bt)
            if not b:
                continue
            size = min(n, len(b))
            wins = {tuple(b[k : k + size]) for k in range(len(b) - size + 1)}
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in wins:
                    hit |= set(range(k, k + size))
                    found.add(str(item))
        out[i] = (len(w), len(hit), sorted(found))
    return out


def cases():
    rng = random.Random(4)
    word = lambda: rng.choice(["alpha", "Beta", "gámma", "d1", "e", "f", "g"]) + str(rng.randrange(4))
    items = [(k, " ".join(word() for _ in range(rng.choice([3, 9, 10, 11, 30])))) for k in range(30)] + [(90, None), (91, ""), (92, "solo"), (93, "twin words here now and so on and on it goes"), (94, "twin words here now and so on and on it goes")]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(0, 120))]
        if i % 3 == 0:
            src = words(items[rng.randrange(30)][1])
            a = rng.randrange(len(src))
            w[10:10] = src[a : a + rng.choice([4, 9, 10, 15])]
        docs.append((i, ", ".join(w)))
    docs += [(100, None), (101, ""), (102, "SOLO!"), (103, "x " * 40000 + "twin words here now and so on and on it goes"), (104, "twin-words here")]
    return docs, items


@pytest.mark.parametrize("limit", [1 << 25, 0])
def test_against_brute_force(spark, limit):
    docs, items = cases()
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in D.decontaminate(d, b, broadcast_bytes=limit).collect()}
    assert got == brute(docs, items)


@pytest.mark.parametrize("limit", [1 << 25, 0])
def test_empty_sides_repeats_and_carried_rows(spark, limit):
    d = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    rows = D.decontaminate(d, none, broadcast_bytes=limit, carry=True).collect()
    assert sorted((r["row"]["doc_id"] or 0, r["n_words"], r["contaminated"]) for r in rows) == [(0, 0, False), (1, 2, False), (1, 2, False)]
    assert D.decontaminate(d.limit(0), none, broadcast_bytes=limit).count() == 0


def test_winnowing_guarantee():
    rng = np.random.default_rng(0)
    for n in (6, 7, 20, 200):
        h = rng.integers(0, 8, n, dtype=np.uint64)
        kept = set(D.winnow(h, 6).tolist())
        for i in range(n - 5):
            low = h[i : i + 6].min()
            assert all(i + k in kept for k in range(6) if h[i + k] == low)
