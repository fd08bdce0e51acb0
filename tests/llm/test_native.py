"""Mixing, secrets, quotations, sharding, fingerprints: brute force, and edges."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.oracle import same
from tidemark.llm import decontaminate, fingerprints, language, mixing, queries, quotations, secrets, sharding, toxicity
from tidemark.llm.shared import Scratch


def py_fill(budget, caps, weights):
    """Water-filling by repeated rounds."""
    got, open_ = dict.fromkeys(caps, 0.0), {k for k in caps if weights[k] > 0}
    left = min(budget, sum(caps[k] for k in open_))
    while open_:
        rate = left / sum(weights[k] for k in open_)
        full = {k for k in open_ if caps[k] <= rate * weights[k] + 1e-9}
        if not full:
            return got | {k: rate * weights[k] for k in open_}
        for k in full:
            got[k] = caps[k]
            left -= caps[k]
        open_ -= full
    return got


def test_budgets_follow_the_tree(spark):
    rng = random.Random(1)
    leaves = [(a, b, rng.randrange(1, 1000)) for a in "xyz" for b in "pqr"]
    df = spark.createDataFrame([(a, b, t, 1) for a, b, t in leaves], "_l0 string, _l1 string, tokens long, docs long")
    weights = {"_l0": {"x": 0.7, "y": 0.2, "z": 0.1}, "_l1": {"p": 3.0, "*": 1.0}}
    for fraction, epochs in [(0.3, 1), (1.0, 1), (1.5, 2), (5.0, 3)]:
        got = {(r["_l0"], r["_l1"]): r["got"] for r in mixing.leaf_budgets(df, ["_l0", "_l1"], weights, fraction, epochs).collect()}
        caps = {a: sum(t for x, _, t in leaves if x == a) * epochs for a in "xyz"}
        top = py_fill(fraction * sum(t for *_, t in leaves), caps, weights["_l0"])
        want = {}
        for a in "xyz":
            own = {b: t * epochs for x, b, t in leaves if x == a}
            want |= {(a, b): v for b, v in py_fill(top[a], own, {b: 3.0 if b == "p" else 1.0 for b in own}).items()}
        assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_mix_takes_prefixes(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 7)
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 9), rng.choice("ab")) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for fraction, epochs in [(0.5, 1), (1.0, 3), (2.2, 4)]:
        out = mixing.mix(df, {"source": F.col("source")}, {"source": {"a": 0.8, "b": 0.2}}, fraction, epochs, 5)
        got = Counter((r["doc_id"], r["epoch"]) for r in out.collect())
        assert max(got.values()) == 1
        size = {i: t.count("w") for i, t, _ in rows}
        total = sum(size.values())
        caps = {s: sum(size[i] for i, _, x in rows if x == s) for s in "ab"}
        budget = py_fill(fraction * total, {s: c * epochs for s, c in caps.items()}, {"a": 0.8, "b": 0.2})
        for s in "ab":
            ids = [i for i, _, x in rows if x == s]
            full = min(epochs, int((budget[s] + 1e-6) // caps[s]))
            rest, run, want = int(budget[s] + 1e-6) - full * caps[s], 0, {(i, e) for i in ids for e in range(1, full + 1)}
            for i in sorted(ids, key=lambda i: (int(hashlib.sha256(f"5:{full + 1}:{i}".encode()).hexdigest()[:15], 16), str(i))):
                run += size[i]
                if run > rest or rest <= 0:
                    break
                want.add((i, full + 1))
            assert {k for k in got if k[0] in set(ids)} == want


def test_mix_edges(spark):
    df = spark.createDataFrame([(1, None, None, 3), (2, "", "a", 3), (None, "x y", "a", 3), (4, "x " * 60000, "b", 3), (4, "x " * 60000, "b", 3)], "doc_id long, text string, source string, epoch int")
    out = mixing.mix(df, {"source": F.col("source")}, {}, 1.0, 1)
    assert out.count() == 5 and out.where("epoch = 1").count() == 5
    assert mixing.mix(df.limit(0), {"source": F.col("source")}, {}).count() == 0


def base(text):
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def test_secrets(spark):
    rng = random.Random(1)
    key = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    b62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts = [
        None, "", "token:secret:abcdefghijk", "PassWord = 'hunter2hunter2' é token=short", f"x {key(40, b62)} y", "AKIA" + "A" * 11, "AKIA" + "B7" * 8, key(32, "0123456789abcdef"), key(31, "0123456789abcdef"),
        "api_key: aaaaaaaa, apikey=bbbbbbbb secret = secret = cccccccc", "😀 token=" + "z" * 9 + " " + key(64, "abcdef0123456789"), "plain words that nobody would call a secret whatsoever", "the_configuration_parameter_of_the_module " * 3000, "a﷐b token=12345678",
    ]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(i, f"ordinary identifier number words_of_text some-long-name {i} configuration parameter module", "clash") for i in range(100, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, secrets string")
    out = {r["doc_id"]: r for r in secrets.scan(df, secrets.train(df.where("doc_id >= 100"))).collect()}
    for i, t, _ in rows:
        found = [(s["start"], s["kind"], s["end"]) for s in out[i]["secrets"]]
        assert [s for s in found if s[1] < 3] == base(t or "")
        assert all(s["value"] == (t or "").replace("﷐", "�")[s["start"] : s["end"]] for s in out[i]["secrets"])
    assert [s["kind"] for s in out[4]["secrets"]] == [3]
    assert not out[11]["secrets"] and not out[12]["secrets"] and not out[150]["secrets"]


def test_random_strings_held_out(spark):
    """Rates of the fourth kind on strings that the training never saw."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = secrets.train(docs.select("doc_id", "text"))
    assert model.recall > 0.95 and (model.false_alarms or 0) < 0.02 and model.min_ratio > 0
    rng = random.Random(77)
    b62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    fresh = [("x " + "".join(rng.choice(b62) for _ in range(rng.randrange(24, 60))) + " y", True) for _ in range(300)]
    words = "configuration parameter interface description template database connection maximum temporary directory resource identifier response handler".split()
    fresh += [("x " + rng.choice("_-/").join(rng.choice(words) for _ in range(rng.randrange(2, 5))) + "_module y", False) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(fresh)], "doc_id long, text string")
    hit = {r["doc_id"]: any(s["kind"] == 3 for s in r["secrets"]) for r in secrets.scan(df, model).collect()}
    assert sum(hit[i] for i, (_, y) in enumerate(fresh) if y) >= 0.95 * 300 and sum(hit[i] for i, (_, y) in enumerate(fresh) if not y) <= 0.02 * 300


def test_secrets_of_nothing(spark):
    df = spark.createDataFrame([(1, None, "clash")], "doc_id long, text string, secrets string")
    assert secrets.scan(df.limit(0), secrets.train(df.limit(0))).count() == 0


def order_of(rows):
    """Turns in depth-first order of replies, by hand."""
    below = {}
    for turn, parent in sorted(rows):
        below.setdefault(parent, []).append(turn)
    out, work = [], [None]
    while work:
        at = work.pop()
        if at is not None:
            out.append(at)
        work += reversed(below.get(at, []))
    return out


def test_quotations(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow are you?\n\nBest"), (1, 1, "assistant", "> Hello there.\n> How are you?\n\nFine, thanks."), (1, 2, "user", "What about lunch?"), (1, 3, "assistant", "> Hello there.\nAgain hi"),
        (1, 4, "user", "ok go on"), (1, 5, "user", ">> Hello there.\n> Again hi\n> nothing\nsure"), (1, 6, "user", "> Fine,  thanks\nnested?"), (1, 7, "user", "> never said\nhm"), (2, 0, "user", None), (2, 0, "user", None), (None, 1, "user", "> x"), (2, None, None, ""),
        (3, 2, "user", "One sentence here. Another, much longer one, follows it. The end of it."), (3, 4, "user", "well"), (3, 9, "user", "> Another, much\n> longer one,\n> follows it.\nyes"), (3, 12, "user", "last"),
    ]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, body string, _turn int")
    got = {(r["conv_id"], r["turn"]): r for r in quotations.link(df).collect()}
    assert {k[1]: r["parent_turn"] for k, r in got.items() if k[0] == 1} == {0: None, 1: 0, 2: 1, 3: 0, 4: 3, 5: 3, 6: 1, 7: 6}
    assert got[1, 1]["body"] == "Fine, thanks." and got[1, 5]["body"] == "sure" and got[2, 0]["body"] == ""
    assert [(q["level"], q["turn"]) for q in got[1, 5]["quotes"]] == [(1, 3), (2, 0)] and got[1, 7]["quotes"][0]["turn"] is None
    assert [t for _, t in sorted((r["place"], k[1]) for k, r in got.items() if k[0] == 1)] == [0, 1, 2, 6, 7, 3, 4, 5]
    # a sentence of a longer line, wrapped again; turns with gaps
    assert {k[1]: (r["parent_turn"], r["place"]) for k, r in got.items() if k[0] == 3} == {2: (None, 2), 4: (2, 3), 9: (2, 4), 12: (9, 5)}
    assert quotations.link(df).count() == len(rows) and quotations.link(df.limit(0)).count() == 0


def planted(seed, conversations, length):
    """Messages that quote earlier ones, whole or in part, wrapped or nested, and the turn that each of them answers."""
    rng = random.Random(seed)
    rows, truth = [], {}
    for conv in range(conversations):
        said, turn = [], 0
        for _ in range(rng.randrange(1, length)):
            turn += rng.choice([1, 1, 1, 2, 5])
            sentences = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(4, 9))) + rng.choice(".?!") for _ in range(rng.randrange(2, 7))]
            body, parent, lines = "\n\n".join(" ".join(sentences[k : k + 3]) for k in range(0, len(sentences), 3)), said[-1][0] if said else None, []
            if said and rng.random() < 0.6:
                parent, about = rng.choice(said)
                form = rng.randrange(4)
                text = about if form == 0 else rng.choice(about.split("\n\n")) if form == 1 else rng.choice(re.split(r"(?<=[.?!])\s+", about))
                if form == 3:
                    text = re.sub(r"(\S+ \S+ \S+) ", r"\1\n", text)
                lines = ["> " + x for x in text.split("\n")]
                if len(said) > 1 and rng.random() < 0.3:
                    lines = [">> " + x for x in rng.choice(said)[1].split("\n")] + lines
            rows.append((conv, turn, rng.choice(["user", "assistant"]), "\n".join([*lines, body])))
            truth[conv, turn] = parent
            said.append((turn, body))
    return rows, truth


@pytest.mark.parametrize("block", [1024, 3])
def test_planted_quotes(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(quotations, "BLOCK", block)
    rows, truth = planted(4, 40, 25)
    spark.createDataFrame([*rows, (7, None, "user", "> a"), (None, 3, None, None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = Scratch(spark, "t").save(queries.op6_quotations(spark, str(tmp_path)), "out")
    got = {(r["conv_id"], r["turn"]): r for r in out.collect()}
    assert {k: got[k]["parent_turn"] for k in truth} == truth
    for conv in {k[0] for k in truth}:
        want = order_of([(t, p) for (x, t), p in truth.items() if x == conv])
        assert [t for _, t in sorted((got[k]["place"], k[1]) for k in truth if k[0] == conv)] == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    same(out, con, queries.OP6_SQL)


def test_a_long_chain_of_branches_takes_few_jobs(spark):
    n = 10_000  # every message answers the one before the last, so two chains interleave
    rows = spark.range(n).selectExpr("id as turn", "'user' as role", "case when id < 2 then concat('m', id) else concat('> m', id - 2, '\n', 'm', id) end as text")
    rows = rows.withColumn("conv_id", F.lit(1))
    group = "chain"
    spark.sparkContext.setJobGroup(group, group)
    got = quotations.link(rows).select("turn", "place").collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext._jsc.clearJobGroup()
    order = [r["turn"] for r in sorted(got, key=lambda r: r["place"])]
    # the first two are 0 and 1, which answers 0 by the order of turns; then come the answers to 1 before those to 0
    assert order == order_of([(0, None), (1, 0), *((k, k - 2) for k in range(2, n))])
    assert len(jobs) < 80


CLASHES = """_key _l0 _l1 _m0 _m_key _m_tokens tokens docs full rest got cut cap weight buckets _b _h _last _letters _base _id _text _grade h secrets_ slot_
    _tail d print next_print edited _fp_p _fp_q _bucket _conv _turn body quotes parent_turn place page_id html payload_sha1 refers_to _item""".split()


def test_columns_named_like_internal_ones(spark):
    rows = [(f"doc-{i}", f"Some words of text number {i}, enough of them to matter. token={i}abcdefgh", "en" if i % 2 else "de", "src1", *["clash"] * len(CLASHES)) for i in range(40)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ["doc_id", "text", "lang", "source", *CLASHES]))
    every = set(df.columns)
    mixed = mixing.mix(df, {"lang": F.col("lang"), "source": F.col("source")}, {"lang": {"en": 0.5, "*": 0.5}}, 0.9, 2)
    assert every < set(mixed.columns) and mixed.where("cut = 'clash' and tokens = 'clash'").count() == mixed.count() > 0
    found = secrets.scan(df, secrets.train(df))
    assert every < set(found.columns) and found.where("size(secrets) = 1 and _base = 'clash'").count() == 40
    known = language.identify(df, language.train(df))
    assert every < set(known.columns) and known.where("_letters = 'clash' and lang_pred <> 'und'").count() == 40
    labels = spark.createDataFrame([(f"doc-{i}", i % 3, "clash", "clash") for i in range(30)], "doc_id string, toxic int, text string, _grade string")
    graded = toxicity.grade(df, toxicity.fit(df, labels))
    assert every < set(graded.columns) and graded.where("_grade = 'clash'").count() == 40
    assert every < set(sharding.place(df, ["a", "b"]).columns)
    items = spark.createDataFrame([("q1", "Some words of text number 7, enough of them to matter. token", "clash")], "item_id string, text string, _item string")
    clean = decontaminate.decontaminate(df, items, carry=True)
    assert clean.where("n_items = 1").select("doc_id").collect()[0][0] == "doc-7" and every == set(clean.select("row.*").columns)


def test_sharding(spark):
    names = [f"s{i}" for i in range(7)]
    table = sharding.fill(names, 1009)
    n = Counter(table)
    assert len(table) == 1009 and max(n.values()) - min(n.values()) <= 1
    order = {n: [(int.from_bytes(hashlib.sha256(n.encode()).digest()[:8], "big") + k * (int.from_bytes(hashlib.sha256(n.encode()).digest()[8:16], "big") % 1008 + 1)) % 1009 for k in range(1009)] for n in names}
    plain, turn = {}, 0
    while len(plain) < 1009:  # shards in turn take the first free slot of their permutation
        plain[next(s for s in order[names[turn % 7]] if s not in plain)] = turn % 7
        turn += 1
    assert table == [plain[s] for s in range(1009)]
    fewer = sharding.fill(names[:-1], 1009)
    assert sum(a != b for a, b in zip(table, fewer, strict=True)) < 1009 * 0.35
    w = Counter(sharding.fill(["a", "b"], 1009, [3, 1]))
    assert abs(w[0] / w[1] - 3) < 0.05
    df = spark.createDataFrame([(1, "x", 9), (1, "y", 9), (None, "a", 9), (None, "b", 9), (None, None, 9)], "doc_id long, text string, slot int")
    got = sharding.place(df, names).collect()
    assert len({r["slot"] for r in got if r["doc_id"] == 1}) == 1 and len({r["slot"] for r in got if r["doc_id"] is None}) == 3
    key = lambda t: int(hashlib.sha256(t.encode()).hexdigest()[:15], 16) % sharding.SLOTS
    assert {r["slot"] for r in got if r["doc_id"] == 1} == {key("1")}
    assert sharding.place(df.limit(0), names).count() == 0
    path = Scratch(spark, "t").path("shards")
    sharding.write_shards(spark.range(500).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")).transform(sharding.place, names), path, 2)
    back = spark.read.parquet(path)
    assert back.count() == 500 and back.select("shard").distinct().count() == 7


def pieces(t):
    """Lines and sentences; long ones cut behind marked words, or behind characters in a long word."""
    out = set()
    for p in re.split(r"\n|(?<=[.!?])[ \t]+|(?<=[。！？])", t):
        parts, cur = [p], []
        if len(p) > fingerprints.LONG:
            parts = []
            for k, w in enumerate(p.split(" ")):
                cur.append(" " if k else "")
                if len(w) > fingerprints.LONG:
                    for c in w:
                        cur.append(c)
                        if ord(c) % fingerprints.CODE_CUT == 7:
                            parts.append("".join(cur))
                            cur = []
                else:
                    cur.append(w)
                    if xxhash.xxh64(w.encode(), seed=42).intdigest() % fingerprints.WORD_CUT == 0:
                        parts.append("".join(cur))
                        cur = []
            parts.append("".join(cur))
        out |= set(parts)
    return out - {""}


def like(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def odd_texts():
    rng = random.Random(5)
    texts = {i * 3: " ".join(f"s{rng.randrange(50 if i % 4 else 10**6)}." for _ in range(rng.randrange(0, 60))) for i in range(80)}
    texts |= {900: None, 901: "", 902: "é😀" * 500, 903: "\n".join(f"line {i}" for i in range(3000)), 904: texts[3], 905: texts[3]}
    texts |= {906: "\n".join(f"line {i}" for i in range(10, 3010)), 907: "".join(rng.choice("abcdefg") for _ in range(20000)), 908: " ".join(f"w{rng.randrange(10**6)}" for _ in range(3000)), 909: "一。二。三。"}
    return texts


@pytest.mark.parametrize("third", [4, 1])  # with thirds of one cell nothing peels at first, and most blocks list their digests
def test_fingerprints(spark, monkeypatch, third):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 9)
    monkeypatch.setattr(fingerprints, "THIRD", third)
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in texts.items()], "doc_id long, text string, next string, _bucket string")
    saved = Scratch(spark, "t").save(fingerprints.edited_versions(df), "prints")
    got = {r["doc_id"]: r for r in saved.collect()}
    ids = sorted(texts)
    for k, i in enumerate(ids):
        t, nxt = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got[i]["near_edited"] - like(pieces(t), pieces(edited))) < 1e-12
        assert abs(got[i]["near_next"] - like(pieces(t), pieces(nxt))) < 1e-12
    assert got[904]["fingerprint"] == got[905]["fingerprint"] == got[3]["fingerprint"] != got[6]["fingerprint"]
    # the returned strings alone give the likeness, of any two
    again = fingerprints.with_likeness(saved.select("doc_id", "fingerprint", "edited_fingerprint", "near_edited"), "fingerprint", "edited_fingerprint", "again")
    assert again.where("again <> near_edited").count() == 0
    some = saved.where("doc_id in (3, 900, 902, 903, 904, 906, 907, 908)").select("doc_id", "fingerprint")
    pairs = some.crossJoin(some.select(F.col("doc_id").alias("other"), F.col("fingerprint").alias("theirs")))
    for r in fingerprints.with_likeness(pairs, "fingerprint", "theirs", "near").collect():
        assert abs(r["near"] - like(pieces(texts[r["doc_id"]] or ""), pieces(texts[r["other"]] or ""))) < 1e-12
    if third == 4:
        assert saved.where("fingerprint like '%99,%'").count() < 20 and like(pieces(texts[903]), pieces(texts[906])) > 0.9


def test_cells_of_several_digests_that_look_like_one(spark, monkeypatch):
    """with a check of 2 bits, many do. Counts then left their bits by subtracting the same false digest again and again."""
    monkeypatch.setattr(fingerprints, "_CHECK", 2)
    monkeypatch.setattr(fingerprints, "PER_BLOCK", 6)
    rng = random.Random(11)
    texts = [" ".join(f"s{rng.randrange(10**6)}." for _ in range(rng.randrange(1, 120))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r for r in fingerprints.edited_versions(df).select("doc_id", "near_edited", "near_next").collect()}
    for i, t in enumerate(texts):
        nxt = texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert abs(got[i]["near_edited"] - like(pieces(t), pieces(edited))) < 1e-12
        assert abs(got[i]["near_next"] - like(pieces(t), pieces(nxt))) < 1e-12


def test_a_text_without_line_or_sentence_ends_shares_its_first_half(spark):
    rng = random.Random(8)
    words = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(2000))
    letters = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8000))
    for make in (words, letters):
        out = fingerprints.edited_versions(spark.createDataFrame([(i, make()) for i in range(3)], "doc_id long, text string"))
        assert all(0.25 < r["near_edited"] < 0.5 and r["near_next"] < 0.1 for r in out.collect())


def test_fingerprint_edges(spark):
    one = fingerprints.edited_versions(spark.createDataFrame([(7, "a. b.")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0
    rows = spark.createDataFrame([(None, "x"), (1, "y"), (1, "y"), (1, "z")], "doc_id long, text string")
    assert fingerprints.edited_versions(rows).count() == 4
    assert fingerprints.edited_versions(rows.limit(0)).count() == 0
