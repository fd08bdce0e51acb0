"""Near-duplicate groups against brute force over all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import near_dedup

SCHEMA = "doc_id long, text string, label string, n_shingles string"


def brute(rows):
    sets, part = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        part[i] = i
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 75 * len(sets[a] | sets[b]) and part[a] != part[b]:
                lo, hi = sorted((part[a], part[b]))
                part = {k: lo if v == hi else v for k, v in part.items()}
    return {i: (len(sets[i]), part[i]) for i in ids}


def corpus(seed, groups, size, words=60):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for k in range(size):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    return rows


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)
    return {r["doc_id"]: r for r in near_dedup.near_duplicates(df, **more).collect()}


def check(spark, rows):
    got, want = run(spark, rows), brute(rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_groups(spark):
    check(spark, corpus(1, 25, 8))


def test_chains_and_one_large_group(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "NODE", 30)  # large nodes branch as rows, in blocks at the end
    monkeypatch.setattr(near_dedup, "DEPTH", 2)
    rows = corpus(2, 1, 120) + [(1000 + i, t) for i, t in corpus(3, 5, 3)]
    check(spark, rows)


@pytest.mark.parametrize("node", [4096, 40])
def test_a_bridge_by_one_copy_of_a_large_group(spark, monkeypatch, node):
    monkeypatch.setattr(near_dedup, "LEAF", 16)
    monkeypatch.setattr(near_dedup, "NODE", node)
    base = [f"b{i}" for i in range(300)]
    rows = [(i, " ".join([*base, *(f"t{i}x{k}" for k in range(3))])) for i in range(200)]
    rows.append((500, " ".join(rows[77][1].split()[74:])))  # 75.3 % with 77, 73.5 % with the other copies
    want = brute(rows)
    assert want[500][1] == 0 and brute([r for r in rows if r[0] != 77])[500][1] == 500
    check(spark, rows)


@pytest.mark.parametrize(("groups", "members"), [(8, 320), (1, 4500)])
def test_bridges_at_production_sizes(spark, groups, members):
    """Every group has a document that reaches 75 % with one of its members only; nodes are over 256, or over 4096."""
    rows, of = [], {}
    for g in range(groups):
        base = [f"g{g}b{i}" for i in range(300)]
        first = len(rows)
        rows += [(first + k, " ".join([*base, *(f"g{g}t{k}x{j}" for j in range(3))])) for k in range(members)]
        of[100_000 + g] = (first, " ".join(rows[first + members // 3][1].split()[74:]))
    near = lambda a, b: len(a & b) / len(a | b)
    sets = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    for first, text in of.values():
        one = sets(text)
        assert sum(near(one, sets(t)) >= 0.75 for _, t in rows[first : first + members]) == 1
    got = run(spark, rows + [(i, t) for i, (_, t) in of.items()])
    assert {i: got[i]["component_id"] for i in of} == {i: first for i, (first, _) in of.items()}


@pytest.mark.parametrize("pairs", [400, 2200])
def test_recall_at_the_threshold_in_large_nodes(spark, pairs):
    """Pairs at 75 to 80 % among documents that share most of their words, but are alike to under 75 %."""
    rng = random.Random(pairs)
    common, rows, want = [f"c{i}" for i in range(110)], [], 0
    sets = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    planted = {}
    for p in range(pairs):
        a = [*common, *(f"p{p}w{i}" for i in range(60))]
        while True:
            b = list(a)
            for at in rng.sample(range(len(a)), rng.randrange(2, 8)):
                b[at] = f"p{p}z{at}"
            j = len(sets(a) & sets(b)) / len(sets(a) | sets(b))
            if 0.75 <= j < 0.8:
                break
        planted[2 * p] = 2 * p + 1
        rows += [(2 * p, " ".join(a)), (2 * p + 1, " ".join(b))]
    got = run(spark, rows)
    found = sum(got[b]["component_id"] == a for a, b in planted.items())
    assert found >= 0.99 * pairs and sum(r["kept"] for r in got.values()) == 2 * pairs - found


def test_heavy_nodes_are_confirmed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "WEIGHT", 300)
    monkeypatch.setattr(near_dedup, "LEAF", 16)
    check(spark, corpus(6, 4, 30))


def test_string_ids_and_names_like_internal_ones(spark):
    rows = corpus(9, 6, 4)
    want = brute(rows)
    name = lambda i: f"doc-{i:04d}"
    names = ["node", "rep", "label", "set_key", "_text", "name", "component_id"]
    df = spark.createDataFrame([(name(i), t, *["clash"] * len(names)) for i, t in rows] + [(None, "a b", *["clash"] * len(names))], ", ".join(f"{c} string" for c in ["_id", "text", *names]))
    got = {r["_id"]: r for r in near_dedup.near_duplicates(df, "_id").collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items() if i} == {name(i): (n, name(c)) for i, (n, c) in want.items()}
    assert got[None]["component_id"] is None and got[None]["kept"] and all(r["kept"] == (r["component_id"] == i) for i, r in got.items() if i)


def test_edges(spark):
    long = " ".join(f"t{i}" for i in range(30000))
    rows = [(5, None), (6, ""), (7, " \n\t"), (8, "a b"), (9, "a b"), (10, "a b c d e"), (11, "a b c d e"), (12, long), (13, long + " z"), (14, "é à")]
    check(spark, rows)


def test_repeated_and_null_ids(spark):
    text = " ".join(f"q{i}" for i in range(20))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(-1, -1, True), (-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_empty(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_path_and_a_star(spark):
    from tidemark.llm.shared import Scratch

    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["id"]: r["label"] for r in near_dedup.components(spark, df, Scratch(spark, "t"), "c").collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    assert near_dedup.components(spark, df.where(F.lit(False)), Scratch(spark, "t"), "c").count() == 0


def test_tables_of_few_words(spark):
    """Texts that are read together and have fewer words than one shingle."""
    for texts in (["a"], ["a b", None], ["a b c", "d"], ["", "a b c d"], ["a b c", "a b c"]):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect()}
        assert got == {i: (int(bool(t)), texts.index(t) if t else i) for i, t in enumerate(texts)}
