"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; ``run``
writes every stage's rows to the shared folder and reads them back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, mixing, near_dedup, queries, sharding, toxicity
from tidemark.llm.shared import Scratch

#: Token budget as a share of what reaches the stage; one epoch, as duplicates are gone for good.
MIX_FRACTION, MIX_EPOCHS = 0.9, 1


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _packed(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns that an operator reads, and the whole row as one struct, so that no column of the row can clash with the operator's."""
    return docs.select(*columns, F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose expected severity is under the cut, with all their columns as they were, whatever their names. Null and empty texts
    stay; rows without an id are graded like others; repeated rows stay or go together; an empty table gives none."""
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.grade(_packed(docs, "text"), model).where(~F.col("toxic")).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id.

    Rows of one id are one document: the row stays whose text has the smallest SHA-256 (a null text counts as empty), of equal
    texts that with the smallest hash of the whole row. Rows without an id, and texts without words, are linked with nothing; the
    first all stay, the second are each their own group. An empty table gives none.
    """
    kept = near_dedup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    order = F.struct(F.sha2(F.coalesce("text", F.lit("")), 256), F.xxhash64(F.to_json("row")))
    one = _packed(docs, "doc_id", "text").join(kept, "doc_id").groupBy("doc_id").agg(F.min_by("row", order).alias("row"))
    return one.select("row.*").unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a word inside a benchmark window. Null and empty texts have no words and stay, with or without an id; repeated
    rows stay or go together; an empty table gives none."""
    found = decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"), carry=True)
    return found.where(~F.col("contaminated")).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows chosen for a budget of nine tenths of the tokens, over domain, language and source; a null language or source is a value
    of its own. Null and empty texts have no tokens and go with the prefix that they fall into; rows of one id in a leaf are in or out
    together, as are those without one; an empty table gives none. Columns named as the operator's keep what they held."""
    tree = {"domain": queries.domain_column(), "lang": F.col("lang"), "source": F.col("source")}
    rows = _packed(docs, "doc_id", "text", "lang", "source")
    return mixing.mix(rows, tree, queries.MIX_WEIGHTS, MIX_FRACTION, MIX_EPOCHS, queries.MIX_SEED).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with their ``slot`` and ``shard``, in place of columns of these names. Rows of one id share a shard, rows without one go
    by their text (null as empty); repeated rows all stay; an empty table gives none."""
    return sharding.place(docs, queries.SHARDS)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The first stage is a trained model, which SQL can't express; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that all stages keep, with their shard."""
    scratch = Scratch(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
