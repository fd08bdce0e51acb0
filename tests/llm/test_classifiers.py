"""Language and toxicity: held-out accuracy, and edges."""

import random

from pyspark.sql import functions as F

from tidemark.llm import language, toxicity

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language.train(docs.where(~held))
    out = language.identify(docs.where(held), model)
    r = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r["a"] > 0.98 and 0 <= r["lo"] <= r["hi"] <= 1
    # calibration: in ten bins of the score, mean score and accuracy differ little; what isn't rejected errs less
    rows = [(x["score"], x["lang"] == x["lang_pred"], x["rejected"]) for x in out.where("lang is not null").select("score", "lang", "lang_pred", "rejected").collect()]
    bins = {}
    for score, right, _ in rows:
        bins.setdefault(min(9, int(score * 10)), []).append((score, right))
    error = sum(abs(sum(s for s, _ in b) - sum(y for _, y in b)) for b in bins.values()) / len(rows)
    accepted = [right for _, right, no in rows if not no]
    assert error < 0.05 and len(accepted) > 0.9 * len(rows) and 1 - sum(accepted) / len(accepted) < 0.01


def test_language_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !!", None), (4, "the", "en"), (5, "der und die " * 9000, "de"), (6, "the and of " * 50, "en"), (6, "the and of " * 50, "en")]
    rows += [(100 + i, text * (1 + i % 7), lang) for i in range(40) for text, lang in (("der und die das ", "de"), ("the and of that ", "en"))]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r["doc_id"]: r for r in language.identify(docs, language.train(docs)).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[1]["score"] == 0
    assert got[5]["lang_pred"] == "de" and got[6]["lang_pred"] == "en"
    empty = docs.limit(0)
    assert language.identify(docs, language.train(empty)).where("lang_pred <> 'und'").count() == 0
    assert language.identify(empty, language.train(docs)).count() == 0


def test_toxicity_held_out(spark):
    rng = random.Random(3)
    vocab, bad = [f"word{i}" for i in range(400)], ["vileness", "scumbag", "filthmonger", "dreck"]
    rows = []
    for i in range(1200):
        w = [rng.choice(vocab) for _ in range(rng.randrange(5, 200))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randrange(1, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 4], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert len(model.theta) == 1  # two grades, one threshold
    got = {r["doc_id"]: r for r in toxicity.grade(docs, model).collect()}
    held = [(i, y) for i, _, y in rows if i % 4 == 0]
    assert all(got[i]["toxic"] == bool(y) for i, y in held)
    assert all(0 <= got[i]["severity"] <= 1 for i, _ in held)


def test_given_grades(spark):
    """Four grades by the worst word of a text, mild words speaking against: recall over each threshold on held-out rows."""
    rng = random.Random(4)
    vocab, bad = [f"word{i}" for i in range(400)], {1: ["drat", "fiddle"], 2: ["vileness", "scumbag"], 3: ["filthmonger", "dreckish"]}
    rows = []
    for i in range(2400):
        w = [rng.choice(vocab) for _ in range(rng.randrange(5, 120))]
        grade = rng.choice([0, 0, 1, 2, 3])
        if grade:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(bad[grade]))
        else:
            w.insert(0, rng.choice(["kindly", "thanks", "please"]))
        rows.append((i, " ".join(w), grade))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(0, "a second text of one id")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows if i % 4], "doc_id long, toxic int"))
    assert len(model.theta) == 3 and (model.theta[1:] >= model.theta[:-1]).all() and (model.weights < 0).any()
    got = {r["doc_id"]: r for r in toxicity.grade(docs, model).where("text not like 'a second%'").collect()}
    held = [(i, y) for i, _, y in rows if i % 4 == 0]
    for k in range(3):
        over = [got[i]["grade"] > k for i, y in held if y > k]
        under = [got[i]["grade"] > k for i, y in held if y <= k]
        assert sum(over) / len(over) > 0.9 and sum(under) / len(under) < 0.1
    mean = [sum(got[i]["severity"] for i, y in held if y == k) / sum(y == k for _, y in held) for k in range(4)]
    assert mean == sorted(mean)


def test_toxicity_of_given_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    model = toxicity.fit(docs, labels.where(~held))
    out = toxicity.grade(docs.select("doc_id", "text"), model).join(labels.where(held).select("doc_id", F.col("toxic").alias("y")), "doc_id")
    r = out.agg(F.count_if(F.expr("toxic and y = 1")).alias("tp"), F.count_if(F.expr("y = 1")).alias("p"), F.count_if(F.expr("toxic and y = 0")).alias("fp"), F.count_if(F.expr("y = 0")).alias("n")).first()
    assert r["tp"] >= 0.9 * r["p"] and r["fp"] <= 0.02 * r["n"], r


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 7.0), (2, "", 7.0), (3, "x " * 50000, 7.0), (None, "y", 7.0)], "doc_id long, text string, severity double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.grade(docs, toxicity.fit(docs, none)).where("toxic or severity > 0.01").count() == 0
    nulls = spark.createDataFrame([(1, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    assert toxicity.grade(docs, toxicity.fit(docs, nulls)).count() == 4
    assert toxicity.grade(docs.limit(0), toxicity.fit(docs, none)).count() == 0


def test_language_sample_is_bounded_whatever_the_ids(spark, monkeypatch):
    """Null and repeated ids: the sample holds texts of both languages and never more than twice ``per_lang`` of one."""
    seen = []
    counts = language._counts
    rows = [(None if i % 3 else 5, f"das ist ein satz nummer {i} und noch einer", "de") for i in range(300)] + [(i % 2, f"this is a sentence number {i} and one more", "en") for i in range(300)]
    rows += [(9, "the same text all over again", "en")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    real = language.np.argsort
    monkeypatch.setattr(language.np, "argsort", lambda x, *a, **k: (seen.append(len(x)), real(x, *a, **k))[1])
    model = language.train(docs, per_lang=40)
    assert counts is language._counts and 40 <= seen[0] <= 160
    got = {r["lang_pred"] for r in language.identify(docs.select("text"), model).where("text like 'das%'").collect()}
    assert got == {"de"}
    same = spark.createDataFrame([(None, "one text", "en")] * 50, "doc_id long, text string, lang string")
    assert language.train(same, per_lang=40).langs == ["en"]
