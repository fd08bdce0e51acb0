"""Each stage of the pipeline on its own input against brute force; the operators' SQL on a small table."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_near_dedup import brute as brute_groups
from tests.oracle import duck, same
from tidemark.llm import queries, sharding

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    by = dict(P.STAGES)
    clean = by["toxicity"](spark, docs, SF)
    assert clean.columns == COLUMNS and {r["doc_id"] for r in clean.collect()} <= set(kept)

    one = by["near_duplicates"](spark, docs, SF)
    groups = brute_groups(list(kept.items()))
    assert one.columns == COLUMNS and {r["doc_id"] for r in one.collect()} == {i for i, (_, c) in groups.items() if c == i}

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = brute_hits(list(kept.items()), items)
    free = by["decontamination"](spark, docs, SF)
    assert free.columns == COLUMNS and {r["doc_id"] for r in free.collect()} == {i for i, h in hits.items() if not h[1]}

    mixed = by["mixing"](spark, docs, SF)
    ids = [r["doc_id"] for r in mixed.collect()]
    size = lambda t: len(t.split())
    total = sum(size(t) for t in kept.values())
    assert mixed.columns == COLUMNS and len(ids) == len(set(ids)) and 0.75 * total <= sum(size(kept[i]) for i in ids) <= 0.9 * total
    assert by["sharding"](spark, docs, SF).columns == [*COLUMNS, "slot", "shard"]


def test_run_and_repeated_rows(spark):
    assert P.run(spark, SF).where("shard is null").count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(5)
    odd = spark.createDataFrame([(None, None, None, None, None)], docs.schema)
    twice = docs.unionByName(docs).unionByName(odd)
    assert P.drop_near_duplicates(spark, twice, SF).count() <= 6
    for _, stage in P.STAGES:
        stage(spark, odd, SF).collect()
        assert stage(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), duck(SF), queries.ORACLES[name])


def test_stages_keep_columns_of_any_name(spark):
    """Columns named as those of the operators come back as they were, also with nulls and repeated rows."""
    names = ["grade", "severity", "toxic", "epoch", "n_tokens", "row", "kept", "component_id", "n_words", "contaminated", "_text", "_id"]
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, "no id here", None, None, None), (None, None, None, None, None), (-1, None, "en", None, 0), (-2, "", None, "src1", 0)], base.schema)
    rows = base.unionByName(odd).unionByName(odd)
    docs = rows.select("*", *(F.lit(f"mine {n}").alias(n) for n in names))
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        found = out.select(*names).distinct().collect()
        assert [tuple(r) for r in found] == [tuple(f"mine {n}" for n in names)], name
        assert stage(spark, docs.limit(0), SF).count() == 0
        plain = stage(spark, rows, SF).select(COLUMNS)
        assert sorted(map(repr, plain.collect())) == sorted(map(repr, out.select(COLUMNS).collect())), name


def test_one_row_of_a_repeated_id_by_its_text(spark):
    texts = ["one two three four five six seven", "an entirely different text of some other words", None, ""]
    docs = spark.createDataFrame([(7, t, "en", "src1", k) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    first = min(texts, key=lambda t: hashlib.sha256((t or "").encode()).hexdigest())
    for n in (1, 4):
        (row,) = P.drop_near_duplicates(spark, docs.repartition(n), SF).collect()
        assert (row["text"] or "") == (first or "")


def test_mixing_equals_a_plain_version(spark):
    """The stage's rows by the same budgets: prefixes of each leaf in the seeded order, up to the leaf's share of the tokens."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = {r["doc_id"] for r in P.mix_sources(spark, docs, SF).collect()}
    again = {r["doc_id"] for r in P.mix_sources(spark, docs.repartition(3), SF).collect()}
    assert mixed == again
    placed = {r["doc_id"]: r["shard"] for r in P.shard(spark, docs, SF).collect()}
    table = sharding.fill(queries.SHARDS)
    for i, shard in placed.items():
        assert shard == queries.SHARDS[table[int(hashlib.sha256(str(i).encode()).hexdigest()[:15], 16) % sharding.SLOTS]]


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES) - {"op13_neighbours"}))
def test_rows(spark, name):
    table = "conversations" if name.startswith("op6") else "documents"
    assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
