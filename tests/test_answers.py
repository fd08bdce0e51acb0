"""Replay of open questions, the stored index, context resolution, reindexing, and the SQL table function, on small tables."""

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import network as N
from tidemark.operators import quality as Q
from tidemark.operators import search as S
from tidemark.sources.files import shared_path

def body():
    return {"body": (F.col("text"), "B")}


def docs(spark, *texts, start=0):
    return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def asked(spark, *questions):
    return spark.createDataFrame([(i, q.split()) for i, q in enumerate(questions)], "question_id long, tokens array<string>")


def test_the_index_holds_every_position(spark):
    fields = {"title": (F.col("text"), "A"), "same": (F.upper("text"), "A"), "other": (F.lit("Red, red!"), "C")}
    index = S.Index(docs(spark, "red Blue-red", None, "", "ünï9 x" + "y" * 5000), "doc_id", fields)
    got = {(r["key"], r["term"], r["weight"]): (r["n"], r["positions"]) for r in index.postings.collect()}
    assert got[0, "red", "A"] == (4, [0, 2, 3, 5]) and got[0, "blue", "A"] == (2, [1, 4]) and got[0, "red", "C"] == (2, [6, 7])
    assert got[1, "red", "C"] == got[2, "red", "C"] == (2, [0, 1])
    assert got[3, "9", "A"] == (2, [1, 4]) and got[3, "x" + "y" * 5000, "A"] == (2, [2, 5])  # letters outside a to z end a term
    assert len(got) == 9 and {r["term"] for r in index.terms.collect()} == {k[1] for k in got}


def test_only_folders_of_asked_terms_are_read(spark):
    index = S.Index(docs(spark, " ".join(f"w{i}" for i in range(300))), "doc_id", body())
    search = S.Search(index, asked(spark, "w17"))
    assert 0 < len({f.rsplit("bucket=", 1)[1].split("/")[0] for f in search.postings.inputFiles() if "bucket=" in f}) <= S.BUCKETS
    plan = search.postings._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]


def test_the_best_by_bounds_are_the_best_of_all(spark):
    texts = [" ".join(["alpha", "beta", "gamma", "x"][(i * k + k) % 4] for k in range(i % 23 + 1)) for i in range(200)]
    search = S.Search(S.Index(docs(spark, *texts), "doc_id", body()), asked(spark, "alpha beta gamma", "alpha gamma", "beta x alpha gamma"))
    pairs = search.matches()

    def score(df):
        return df.withColumn("rank", F.round(F.col("strict_density") * 0.7 + F.col("relaxed_density") * 0.3, 6))

    strict, relaxed = search.bound()
    everything = score(search.cover_density(pairs))
    assert everything.where((F.col("strict_density") > strict + 1e-9) | (F.col("relaxed_density") > relaxed + 1e-9)).count() == 0
    few = search.best(pairs, strict * 0.7 + relaxed * 0.3, score, "rank", 5)
    rows = lambda df: sorted((r["question_id"], r["doc_id"], r["rank"]) for r in S.capped(df, "rank", "doc_id", 5).collect())
    assert rows(few) == rows(everything) and few.count() < everything.count()


def test_replay_asks_only_what_changes_touch(spark):
    questions = asked(spark, "vlan trunk native", "boot rescue image", "vlan mirror port9")
    rarity = spark.createDataFrame([("vlan", 50), ("trunk", 9), ("boot", 2), ("rescue", 2), ("image", 1)], "token string, n long")
    open_ = S.OpenQuestions(questions, rarity)
    assert {r["question_id"]: r["probe"] for r in open_.stored.collect()} == {0: "native", 1: "image", 2: "mirror"}
    index = S.Index(docs(spark, "vlan trunks and natively more", "a boot image", "mirrored vlan", start=100), "doc_id", body())
    assert {r["question_id"] for r in open_.touched(index).collect()} == {0, 1, 2}
    context = spark.createDataFrame([], "question_id long, words array<string>")
    full = S.semantic_floor(S.Search(index, questions).matches().where("strict"), context).select("question_id", "doc_id")
    assert [tuple(r) for r in open_.answers(index, context).collect()] == [tuple(r) for r in full.collect()] == [(0, 100)]
    none = S.Index(docs(spark, "nothing of it"), "doc_id", body())
    assert open_.touched(none).count() == 0 and open_.answers(none, context).count() == 0


def revisions(spark, n):
    rows = [(i, "command", "cisco", "ios-xe" if i % 2 else "linux", "c9300" if i % 3 else None, None if i % 5 else "k", "show x", None, "t", None, None) for i in range(n)]
    kinds = "revision_id long, kind string, vendor_slug string, os_slug string, platform_slug string, portable_key string, command string, procedure array<string>, title string, version_min string, version_max string"
    return spark.createDataFrame(rows, kinds)


def test_reindex_resumes_and_a_new_version_redoes_all(spark):
    path, rows = shared_path(spark, "reindex-test"), revisions(spark, 60)
    assert N.Reindex(spark, path, "v1", 8).run(rows, 3, 1) == 5
    half = N.Reindex(spark, path, "v1", 8)
    assert half.finished() == [0, 1, 2] and 0 < half.index().count() < 60
    poisoned = rows.where("false")  # what is finished isn't read again
    again = N.Reindex(spark, path, "v1", 8)
    before = {tuple(r) for r in half.index().collect()}
    assert again.run(rows, 2) == 0 and before <= {tuple(r) for r in again.index().collect()}
    once = N.Reindex(spark, shared_path(spark, "reindex-test"), "v1", 8)
    once.run(rows)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(again.index()) == key(once.index()) and once.index().count() == 60
    assert again.run(poisoned) == 0 and again.index().count() == 60
    new = N.Reindex(spark, path, "v2", 8)
    assert new.finished() == [] and new.run(rows) == 0 and {r["classifier"] for r in new.index().collect()} == {"v2"} and again.index().count() == 60


def test_context_over_all_dimensions(spark):
    make = spark.createDataFrame
    vendors = make([(1, "Cisco"), (1, "Cisco Systems"), (2, "Juniper")], "vendor_id long, alias string")
    platforms = make([(10, 1, "Catalyst 9300"), (20, 2, "Catalyst 9300"), (21, 2, "EX4300")], "platform_id long, vendor_id long, alias string")
    systems = make([(100, 1, 7, "IOS XE"), (200, 2, 8, "Junos")], "system_id long, vendor_id long, family_id long, alias string")
    families = make([(7, "IOS XE", False), (8, "Junos", False), (9, "Linux", True)], "family_id long, alias string, portable boolean")
    rows = [
        (1, "cisco", "catalyst 9300", "ios xe", "17.9"),  # all exact
        (2, "cisco", "EX4300", None, None),  # a platform of another vendor; the vendor's own system
        (3, "nobody", None, "linux", "6"),  # a portable family needs no vendor
        (4, "nobody", None, "junos", "1"),  # one of a vendor does
        (5, "cisco", None, "junos", "1"),  # contradictory: the family is named, the vendor hasn't its system
        (6, None, None, None, None),
        (7, "juniper", "Catalyst 9300", "rescue junos", "1"),  # the alias belongs to two vendors; a mode
    ]
    got = {r["request_id"]: r for r in N.joint_context(make(rows, "request_id long, vendor string, model string, system string, version string"), vendors, platforms, systems, families).collect()}
    short = {k: (r["status"], r["vendor_id"], r["platform_id"], r["system_id"], r["family_id"], r["mode"], r["confidence"], r["ambiguities"]) for k, r in got.items()}
    assert short == {
        1: ("resolved", 1, 10, 100, 7, None, 1.0, []),
        2: ("resolved", 1, None, 100, 7, None, 0.6, ["model_unmatched", "version_missing"]),
        3: ("resolved", None, None, None, 9, None, 0.6, ["vendor_unmatched"]),
        4: ("vendor_not_resolved", None, None, None, 8, None, 0.6, ["vendor_unmatched"]),
        5: ("os_not_resolved", 1, None, None, 8, None, 0.7, []),
        6: ("vendor_not_resolved", None, None, None, None, None, short[6][6], ["version_missing"]),
        7: ("resolved", 2, 20, 200, 8, "rescue", 1.0, ["mode_separated"]),
    }


def test_the_table_function_by_lateral(spark):
    day = lambda d: datetime(2024, 1, d)
    rows = [(1, "passed", "batfish_modeled", day(5), day(20)), (1, "passed", "runtime_lab_validated", day(3), day(20)), (1, "passed", "runtime_lab_validated", day(4), day(9)), (1, "failed", "runtime_lab_validated", day(8), day(20)), (2, "passed", "documented", day(2), None), (3, "passed", "documented", day(1), day(30)), (3, "passed", "documented", day(2), day(30))]
    Q.register_current_validation(spark.createDataFrame(rows, "revision_id long, status string, validation_type string, executed_at timestamp, expires_at timestamp"))
    spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id long").createOrReplaceTempView("ids_of_test")
    got = spark.sql("SELECT id, validation_level, lab_validated_at FROM ids_of_test, LATERAL current_knowledge_validation(id, TIMESTAMP '2024-01-10') ORDER BY id").collect()
    assert [tuple(r) for r in got] == [(1, "runtime_lab_validated", day(3)), (3, "documented", day(2))]
