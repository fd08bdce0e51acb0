"""Search of question batches over a corpus (inventory F).

A corpus is one row a document with its terms, positions and field weights in one array. Its index is written once: the terms, and
postings (term, document, weight, positions) in folders by hash of the term. A search reads the folders of the terms that some
question token begins, counts the distinct tokens of each pair of question and document without positions, and drops pairs
under the floor; positions are joined last, for the tokens of the pairs that are left. Where only the best of a question are asked
for, pairs whose upper bound is under the rank already reached never meet their positions. Few questions need no index: each task
makes and scores the pairs of its documents (``scanned``). Terms are ``[a-z0-9]+`` in lower case; a token matches the terms that it begins.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..sources.files import shared_path

# Weights of fields in the cover density.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
#: Terms that questions begin, and question tokens, up to which they are broadcast; more are joined.
FEW_TERMS = 500_000
#: Folders of the postings, parts of a folder (so that a frequent term is in several files), pairs and positions scored at once, and bytes of
#: text indexed at once.
BUCKETS, SPREAD, PAIRS, SCORED, INDEXED = 16, 4, 20_000, 250_000, 2_000_000
#: Parts and answers of questions counted in a task.
COUNTED = 1_000_000


def corpus(docs: DataFrame, key: str, fields: Mapping[str, tuple[Column, str]]) -> DataFrame:
    """(key, words: array of (position, term, weight)); positions run on over the fields in the order given."""
    rows = docs.select(F.col(key), *(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1).alias(f"_w{i}") for i, (text, _) in enumerate(fields.values())))
    start, parts = F.lit(0), []
    def placed(start: Column, weight: str):
        return lambda w, at: F.struct((at + start).alias("position"), w.alias("term"), F.lit(weight).alias("weight"))

    for i, (_, weight) in enumerate(fields.values()):
        parts.append(F.transform(f"_w{i}", placed(start, weight)))
        start = start + F.size(f"_w{i}")
    return rows.select(key, F.concat(*parts).alias("words"))


def postings(indexed: DataFrame, key: str) -> DataFrame:
    """(key, position, term, weight), a row a position."""
    return indexed.select(key, F.inline("words"))


def questions(df: DataFrame, key: str, text: str, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """(question_id, tokens)."""
    return df.select(F.col(key).alias("question_id"), T.question_tokens(F.col(text), dict(aliases or {})).alias("tokens"))


_TERM_BYTES = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", dtype=np.uint8))


def _terms_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of lower-case texts one after another, and the row of each."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = _TERM_BYTES[raw]
    cut = np.zeros(len(raw) + 1, dtype=bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside & (cut[:-1] | ~np.append(False, inside)[:-1]))
    ends = np.flatnonzero(inside & (cut[1:] | ~np.append(inside, False)[1:])) + 1
    at = np.append(0, np.cumsum(ends - starts))
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw[inside].tobytes()))
    return terms, np.searchsorted(offsets, starts, side="right") - 1


def _sliced(batches: Iterator[pa.RecordBatch], texts: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows in slices of at most ``INDEXED`` bytes of text (``texts`` columns behind the first, or all), or of one row."""
    for batch in batches:
        size = np.zeros(batch.num_rows, dtype=np.int64)
        for column in batch.columns[1 : None if texts is None else texts + 1]:
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        for at, to in _parts(size, INDEXED):
            yield batch.slice(at, to - at)


def _parts(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges one after another of a sum of at most ``most``, or of one."""
    end, at = np.cumsum(size), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def _placed(columns: Sequence[pa.Array]) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, np.ndarray]:
    """The terms of a row's texts, column by column, with their row, position (running on over the columns) and column."""
    before = np.zeros(len(columns[0]), dtype=np.int64)
    parts, docs, places, field = [], [], [], []
    for i, column in enumerate(columns):
        terms, doc = _terms_of(column)
        own = np.bincount(doc, minlength=len(before))
        parts.append(terms)
        docs.append(doc)
        places.append(np.arange(len(doc)) - (np.cumsum(own) - own)[doc] + before[doc])
        field.append(np.full(len(doc), i))
        before += own
    return pa.concat_arrays(parts).dictionary_encode(), *map(np.concatenate, (docs, places, field))


def _begun(tokens: Sequence[str], coded: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rank of each of the terms among the distinct ones, and the tokens that begin these: (ranks, tokens, where those of a rank begin, how many they are)."""
    order = pc.sort_indices(coded.dictionary).to_numpy()
    words = coded.dictionary.take(pa.array(order)).to_pylist()
    rank = np.empty(len(words), dtype=np.int64)
    rank[order] = np.arange(len(words))
    # the terms that a token begins lie together; "{" follows "z"
    low = np.array([bisect_left(words, x) for x in tokens], dtype=np.int64)
    n = np.array([bisect_left(words, x + "{") for x in tokens], dtype=np.int64) - low
    met = _ranges(low, n)
    by = np.argsort(met, kind="stable")
    start = np.searchsorted(met[by], np.arange(len(words) + 1))
    return rank[coded.indices.to_numpy()], np.repeat(np.arange(len(tokens)), n)[by], start[:-1], np.diff(start)


def _posted(weights: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, term, weight, n, positions) of rows (key, a text for each weight); positions run on over the texts."""
    kinds = sorted(set(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            coded, doc, place, field = _placed(batch.columns[1:])
            kind = np.array([kinds.index(w) for w in weights])[field]
            key = (doc * max(1, len(coded.dictionary)) + coded.indices.to_numpy()) * len(kinds) + kind
            order = np.argsort(key, kind="stable")
            new = np.flatnonzero(np.append(True, np.diff(key[order]) != 0)[: len(order)])
            first, bounds = order[new], np.append(new, len(order))
            take = lambda words, i: words.take(pa.array(i))
            positions = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(place[order].astype(np.int32)))
            columns = [take(batch.column(0), doc[first]), take(coded.dictionary, coded.indices.to_numpy()[first]).cast(pa.string()), take(pa.array(kinds), kind[first]), pa.array(np.diff(bounds).astype(np.int32)), positions]
            done = pa.RecordBatch.from_arrays(columns, names=["key", "term", "weight", "n", "positions"])
            yield from (done.slice(i, 100_000) for i in range(0, done.num_rows, 100_000))

    return run


class Index:
    """a written inverted index of documents with distinct keys: ``terms``, and ``postings`` (bucket, term, key,
    weight, n, positions), a row a term, document and weight. ``fields`` as for ``corpus``."""

    def __init__(self, docs: DataFrame, key: str, fields: Mapping[str, tuple[Column, str]], path: str | None = None) -> None:
        spark, self.key = docs.sparkSession, key
        self.path = path or shared_path(spark, "index")
        kind = docs.schema[key].dataType.simpleString()
        texts = docs.select(F.col(key), *(F.lower(text).alias(f"_{i}") for i, (text, _) in enumerate(fields.values())))
        bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
        rows = texts.mapInArrow(_posted([w for _, w in fields.values()]), f"key {kind}, term string, weight string, n int, positions array<int>")
        rows = rows.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(SPREAD)))
        rows.write.partitionBy("bucket").parquet(f"{self.path}/postings")
        self.postings = spark.read.schema(f"key {kind}, term string, weight string, n int, positions array<int>, bucket int").parquet(f"{self.path}/postings")
        self.postings.select("bucket", "term").distinct().write.parquet(f"{self.path}/terms")
        self.terms = spark.read.schema("bucket int, term string").parquet(f"{self.path}/terms")


class Search:
    """The questions ``asked`` (question_id, tokens) against an index."""

    def __init__(self, index: Index, asked: DataFrame) -> None:
        spark, self.index, self.key = asked.sparkSession, index, index.key
        self.asked = asked.where(F.size("tokens") > 0).select("question_id", F.array_distinct("tokens").alias("tokens"))
        starts = F.array_distinct(F.array(*(F.substring("term", 1, n) for n in (1, 2, 3, 4))))
        wanted = self.asked.select(F.explode("tokens").alias("token")).distinct().withColumn("_p", F.substring("token", 1, 4))
        # tokens meet the distinct terms by their first characters, four at most
        begun = index.terms.withColumn("_p", F.explode(starts)).join(wanted, "_p").where(F.startswith("term", F.col("token")))
        path = shared_path(spark, "terms")
        begun.select("bucket", "term", "token").write.parquet(path)
        self.begun = spark.read.schema("bucket int, term string, token string").parquet(path)
        self.asked.select(F.explode("tokens").alias("token")).distinct().withColumn("id", F.monotonically_increasing_id()).write.parquet(f"{path}-numbers")
        #: (token, id): distinct tokens of the questions, numbered
        self.numbers = spark.read.schema("token string, id long").parquet(f"{path}-numbers")
        buckets = [r["bucket"] for r in self.begun.select("bucket").distinct().collect()]  # BUCKETS at most
        small = F.broadcast(self.begun) if self.begun.count() <= FEW_TERMS else self.begun
        #: (token, key, weight, n, positions) of the terms that tokens begin, from their folders only
        self.postings = index.postings.where(F.col("bucket").isin(buckets)).join(small, ["bucket", "term"]).withColumnRenamed("key", self.key)

    def matches(self, also: DataFrame | None = None) -> DataFrame:
        """(question_id, key, tokens, n_tokens, mask, n_hits, best, matched, strict): documents in which at least three (or all, if
        fewer) distinct question tokens begin a term; strict: all of them. ``mask`` has the places of these tokens, ``n_hits`` is the
        number of their positions at most, ``rare`` of those of all but the most frequent two, ``fewest`` of one, ``best`` the largest weight. ``also`` (question_id, key) are further pairs to return whatever they match.

        Pairs are formed without positions, one row for each token of a question that a document has, where the document's tokens are.
        """
        weight = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))[F.col("weight")]
        held = self.postings.select("token", self.key, "n", "weight").repartition(self.key).groupBy("token", self.key).agg(F.sum("n").alias("_n"), F.max(weight).alias("_w"))
        each = self.asked.select("question_id", F.posexplode("tokens").alias("_at", "token"))
        each = each.select("question_id", "token", F.pow(F.lit(2), F.col("_at")).cast("int").alias("_bit"))
        each = F.broadcast(each) if each.count() <= FEW_TERMS else each
        rows = held.join(each, "token").select("question_id", self.key, "_bit", "_n", "_w", F.lit(False).alias("_also"))
        if also is not None:
            rows = rows.unionByName(also.select("question_id", self.key, F.lit(0).alias("_bit"), F.lit(0).cast("long").alias("_n"), F.lit(0.0).alias("_w"), F.lit(True).alias("_also")))
        pairs = rows.groupBy("question_id", self.key).agg(F.bit_or("_bit").alias("mask"), F.sum("_n").alias("n_hits"), F.max("_n").alias("_c"), F.sum(F.col("_n") * F.col("_n")).alias("_sq"), F.min(F.when(F.col("_n") > 0, F.col("_n"))).alias("fewest"), F.max("_w").alias("best"), F.max("_also").alias("_also"))
        # hits of all tokens but the most frequent two, at most: the second has at least the mean of the others, weighted by themselves
        others = F.col("n_hits") - F.col("_c")
        pairs = pairs.withColumn("rare", others - F.coalesce(F.ceil(F.try_divide(F.col("_sq") - F.col("_c") * F.col("_c"), others)), F.lit(0))).drop("_c", "_sq")
        n = F.size("tokens")
        full = pairs.withColumn("matched", F.bit_count("mask")).join(F.broadcast(self.asked.withColumn("n_tokens", n)), "question_id")
        full = full.where((F.col("matched") >= F.least(F.lit(3), F.col("n_tokens"))) | F.col("_also"))
        return full.withColumn("strict", F.col("matched") == F.col("n_tokens")).drop("_also")

    def cover_density(self, found: DataFrame) -> DataFrame:
        """the matches with ``strict_density`` and ``relaxed_density``: of the smallest covers of all tokens, and of any three
        (all, if fewer), the sum of (hits / sum of inverse weights) / (1 + words between that are no hits), as r / (r + 1).

        Only here pairs meet positions: those of a document once for all of its pairs. All columns of the pairs go along, but for their
        tokens, which are joined again.
        """
        rest = found.drop("tokens", self.key).columns
        each = self.asked.select("question_id", F.posexplode("tokens").alias("_t", "token")).join(self.numbers, "token")
        ids = each.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_t", "id"))), lambda x: x["id"]).alias("_ids"))
        pairs = found.drop("tokens").join(F.broadcast(ids), "question_id").select(self.key, F.struct(*rest, "_ids").alias("pair"))
        inverse = F.create_map(*(F.lit(x) for k, w in WEIGHTS.items() for x in (k, 1 / w)))[F.col("weight")]
        few = F.broadcast(self.numbers) if self.numbers.count() <= FEW_TERMS else self.numbers
        hits = self.postings.join(few, "token").select(self.key, F.struct("id", inverse.alias("inverse"), "positions").alias("hit"))
        rows = hits.unionByName(pairs, allowMissingColumns=True).groupBy(self.key).agg(F.collect_list("hit").alias("hits"), F.collect_list("pair").alias("pairs")).where(F.size("pairs") > 0)
        kinds = {f.name: f.dataType.simpleString() for f in found.schema.fields}
        schema = ", ".join(f"{x} {kinds[x]}" for x in [self.key, *rest])
        scored = rows.mapInArrow(_dense, f"{schema}, strict_density double, relaxed_density double")
        return scored.join(F.broadcast(self.asked), "question_id").select(*found.columns, "strict_density", "relaxed_density")

    def bound(self) -> tuple[Column, Column]:
        """Upper bounds of both densities of a match, each cover of the largest weight at most. Covers begin and end at different hits.
        A cover of three tokens holds a hit of one that isn't among the most frequent two: as its begin, its end, or in between, where
        only one cover has that hit as the latest of its kind. A cover of all holds a hit of the rarest token, which fewer covers
        than there are tokens share."""
        k = F.least(F.lit(3), F.col("n_tokens"))

        def of(covers: Column, k: Column, able: Column) -> Column:
            r = F.greatest(F.least(covers, F.col("n_hits") - k + 1), F.lit(0)) * F.col("best")
            return F.when(able, r / (r + 1)).otherwise(0.0)

        relaxed = F.when(k == 3, 3 * F.col("rare")).otherwise(F.col("n_hits"))
        return of(F.col("n_tokens") * F.col("fewest"), F.col("n_tokens"), F.col("strict")), of(relaxed, k, F.col("matched") >= k)

    def best(self, found: DataFrame, upper: Column, score: Callable[[DataFrame], DataFrame], rank: str, cap: int = 100) -> DataFrame:
        """matches of each question with their ``rank``, among them its ``cap`` best. ``score`` adds ``rank`` to pairs with densities,
        ``upper`` is never under it. The ``cap`` pairs of the highest bound are scored first; of the others only those whose bound reaches
        the least rank of these."""
        spark, path = found.sparkSession, shared_path(found.sparkSession, "pairs")
        w = W.partitionBy("question_id").orderBy(F.desc("_upper"), self.key)
        found.withColumn("_upper", upper).write.parquet(f"{path}/all")
        pairs = spark.read.parquet(f"{path}/all")
        first = pairs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")
        score(self.cover_density(first)).write.parquet(f"{path}/first")
        first = spark.read.parquet(f"{path}/first")
        least = first.groupBy("question_id").agg(F.min(rank).alias("_least"), F.count("*").alias("_n")).where(F.col("_n") == cap)
        rest = pairs.join(F.broadcast(least), "question_id").where(F.col("_upper") >= F.col("_least") - 1e-5).join(first.select("question_id", self.key), ["question_id", self.key], "left_anti")
        return first.unionByName(score(self.cover_density(rest.drop("_least", "_n")))).drop("_upper")


#: Cells of documents times question tokens that ``strict`` holds at once.
CELLS = 32_000_000


def _answering(tokens: Sequence[str], wanted: Sequence[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (key, texts): (question, key) of the documents that hold all of its tokens, and (token, n), the documents of the slice that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, CELLS // max(1, len(tokens)))
        for batch in (part.slice(at, most) for part in _sliced(batches) for at in range(0, part.num_rows, most)):
            terms, docs = zip(*map(_terms_of, batch.columns[1:]))
            coded = pa.concat_arrays(terms).dictionary_encode()
            rank, token, start, of = _begun(tokens, coded)
            doc, word = np.divmod(np.unique(np.concatenate(docs) * max(1, len(of)) + rank), max(1, len(of)))
            n = of[word]
            held = np.zeros((len(tokens), batch.num_rows), dtype=bool)
            held[token[_ranges(start[word], n)], np.repeat(doc, n)] = True
            count = held.sum(axis=1)
            found = []
            for own in wanted:
                rare = np.flatnonzero(held[own[np.argmin(count[own])]])
                found.append(rare[held[np.ix_(own, rare)].all(axis=0)] if len(rare) else rare)
            some = np.flatnonzero(count)
            asked, rows = np.repeat(np.arange(len(wanted)), [len(x) for x in found]), np.concatenate([np.zeros(0, dtype=np.int64), *found])
            none = lambda kind, n: pa.nulls(n, kind)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(asked), none(pa.int64(), len(some))]), pa.concat_arrays([batch.column(0).take(pa.array(rows)), none(batch.column(0).type, len(some))]), pa.concat_arrays([none(pa.int64(), len(rows)), pa.array(some)]), pa.concat_arrays([none(pa.int64(), len(rows)), pa.array(count[some])])],
                names=["question", "key", "token", "n"],
            )

    return run


def strict(docs: DataFrame, key: str, fields: Mapping[str, tuple[Column, str]], asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """F3 without positions: (question_id, key, tokens, mask), the documents that hold all tokens of a question, and (token, n), about how many
    hold each token. Of few questions (``FEW_QUESTIONS``) documents are read once, and neither terms nor postings are shuffled; more are
    answered from an index."""
    spark, path = docs.sparkSession, shared_path(docs.sparkSession, "strict")
    asked = asked.where(F.size("tokens") > 0).select("question_id", F.array_distinct("tokens").alias("tokens"))
    rows = asked.limit(FEW_QUESTIONS + 1).collect()
    if len(rows) > FEW_QUESTIONS:
        search = Search(Index(docs, key, fields), asked)
        return search.matches().where("strict").select("question_id", key, "tokens", "mask"), search.postings.groupBy("token").agg(F.count("*").alias("n"))
    tokens = sorted({x for r in rows for x in r["tokens"]})
    place = {x: i for i, x in enumerate(tokens)}
    wanted = [np.array([place[x] for x in r["tokens"]], dtype=np.int64) for r in rows]
    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(key), *(F.lower(text).alias(f"_{i}") for i, (text, _) in enumerate(fields.values())))
    schema = f"question long, key {kind}, token long, n long"
    texts.mapInArrow(_answering(tokens, wanted), schema).write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    few = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], StructType([StructField("question", LongType()), *asked.schema.fields]))
    names = spark.createDataFrame(list(enumerate(tokens)), "id long, name string")
    found = out.where("question is not null").join(F.broadcast(few), "question")
    mask = (F.pow(F.lit(2), F.size("tokens")) - 1).cast("int")
    counts = out.where("token is not null").groupBy("token").agg(F.sum("n").alias("n")).withColumnRenamed("token", "id")
    return found.select("question_id", F.col("key").alias(key), "tokens", mask.alias("mask")), counts.join(F.broadcast(names), "id").select(F.col("name").alias("token"), "n")


class OpenQuestions:
    """Questions without an answer, stored by their rarest token, so that changed documents find those that they may answer without
    a new search of the rest.

    An answer holds all tokens of its question, so it holds the rarest one, whichever that was when the question was stored:
    ``rarity`` (token, n) only decides how many questions a change touches. Written as (probe, question_id, tokens).
    """

    def __init__(self, asked: DataFrame, rarity: DataFrame) -> None:
        spark, path = asked.sparkSession, shared_path(asked.sparkSession, "open")
        each = asked.where(F.size("tokens") > 0).select("question_id", F.array_distinct("tokens").alias("tokens")).withColumn("token", F.explode("tokens"))
        rare = F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token"))
        each.join(rarity.select("token", "n"), "token", "left").groupBy("question_id", "tokens").agg(rare.alias("probe")).write.parquet(path)
        self.stored = spark.read.parquet(path)

    def touched(self, index: Index) -> DataFrame:
        """(question_id, tokens) of the questions whose probe begins a term of the index of changed documents."""
        starts = F.array_distinct(F.array(*(F.substring("term", 1, n) for n in (1, 2, 3, 4))))
        probes = self.stored.select("probe").distinct().withColumn("_p", F.substring("probe", 1, 4))
        met = index.terms.withColumn("_p", F.explode(starts)).join(probes, "_p").where(F.startswith("term", F.col("probe"))).select("probe").distinct()
        return self.stored.join(met, "probe").select("question_id", "tokens")

    def answers(self, index: Index, context: DataFrame) -> DataFrame:
        """(question_id, key): changed documents that match all tokens of an open question and pass the semantic floor."""
        found = Search(index, self.touched(index)).matches().where("strict")
        return semantic_floor(found, context).select("question_id", index.key)

    def answered_by(self, docs: DataFrame, key: str, fields: Mapping[str, tuple[Column, str]], context: DataFrame) -> DataFrame:
        """As ``answers``, of changed documents without an index: they are read once."""
        found, _ = strict(docs, key, fields, self.stored)
        return semantic_floor(found, context).select("question_id", key)


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of ``n`` each, one after another."""
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


def _lists(column: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The values of lists, and where each begins and how many it has."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.flatten(), offsets[:-1] - offsets[0], np.diff(offsets)


def _dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both densities, of rows (key, hits (id, inverse, positions), pairs (..., _ids)). A pair has the positions of the tokens in its mask."""
    for batch in batches:
        hits, _, n_hits = _lists(batch.column("hits"))
        pairs, _, n_pairs = _lists(batch.column("pairs"))
        places, place_at, place_n = _lists(hits.field("positions"))
        places, inverses = places.to_numpy(), hits.field("inverse").to_numpy()
        ids, id_at, id_n = _lists(pairs.field("_ids"))
        known, code = np.unique(np.concatenate([hits.field("id").to_numpy(), ids.to_numpy()]), return_inverse=True)
        hit_code = np.repeat(np.arange(batch.num_rows), n_hits) * len(known) + code[: len(hits)]
        order = np.argsort(hit_code, kind="stable")
        hit_code, pair_code = hit_code[order], code[len(hits) :]
        doc = np.repeat(np.arange(batch.num_rows), n_pairs)
        n_tokens, mask = pairs.field("n_tokens").to_numpy(), pairs.field("mask").to_numpy()
        names = [f.name for f in pairs.type if f.name != "_ids"]
        for start in range(0, len(doc), PAIRS):
            stop = min(len(doc), start + PAIRS)
            pair = np.repeat(np.arange(start, stop), id_n[start:stop])
            token = _ranges(np.zeros(stop - start, dtype=np.int64), id_n[start:stop])
            wanted = doc[pair] * len(known) + pair_code[_ranges(id_at[start:stop], id_n[start:stop])]
            held = (mask[pair] >> token) & 1 > 0
            pair, token, wanted = pair[held], token[held], wanted[held]
            first = np.searchsorted(hit_code, wanted)
            n = np.searchsorted(hit_code, wanted, side="right") - first
            entry = order[_ranges(first, n)]
            pair, token, n = np.repeat(pair, n) - start, np.repeat(token, n), place_n[entry]
            for at, to in _parts(np.bincount(pair, n, minlength=stop - start).astype(np.int64), SCORED):
                e = slice(*np.searchsorted(pair, [at, to]))
                dense = _covers(np.repeat(pair[e] - at, n[e]), places[_ranges(place_at[entry[e]], n[e])].astype(np.int64), np.repeat(token[e], n[e]), np.repeat(inverses[entry[e]], n[e]), n_tokens[start + at : start + to])
                part = pairs.slice(start + at, to - at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[start + at : start + to])), *(part.field(x) for x in names), *map(pa.array, dense)], names=[batch.schema.names[0], *names, "strict_density", "relaxed_density"])


def _covers(pair: np.ndarray, place: np.ndarray, token: np.ndarray, inverse: np.ndarray, n_tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strict and relaxed cover density of pairs, of the positions of their tokens; 0 for pairs that hold fewer tokens than a cover.

    For each hit the latest hits of all tokens, sorted: the ``k``-th latest begins the smallest cover that ends here. It is new if it
    begins behind the cover before.
    """
    order = np.lexsort((place, pair))
    pair, place, token, inverse = pair[order], place[order], token[order], inverse[order]
    new = np.append(True, (pair[1:] != pair[:-1]) | (place[1:] != place[:-1])) if len(pair) else np.zeros(0, dtype=bool)
    hit = np.cumsum(new) - 1  # tokens that begin one term share its hit
    pair, place, inverse = pair[new], place[new], inverse[new]
    here = np.arange(len(pair))
    start = np.searchsorted(pair, pair)
    last = np.full((len(pair), int(n_tokens.max(initial=1))), -1, dtype=np.int32)
    last[hit, token] = hit
    np.maximum.accumulate(last, axis=0, out=last)
    last[last < start[:, None]] = -1  # of the pair before
    last = -np.sort(-last, axis=1)
    total = np.cumsum(inverse)
    out = []
    for k in (n_tokens, np.minimum(n_tokens, 3)):
        first = last[here, k[pair] - 1] if len(pair) else here
        before = np.append(-1, first[:-1])[: len(first)]
        before[here == start] = -1
        end = np.flatnonzero((first >= 0) & (first > before))
        f = first[end]
        gain = (end - f + 1) / (total[end] - total[f] + inverse[f]) / (1 + (place[end] - place[f]) - (end - f))
        r = np.bincount(pair[end], gain, minlength=len(n_tokens))
        out.append(r / (r + 1))
    return out[0], out[1]


#: Questions up to which ``alike`` sends their trigrams to every task; more are joined by ``network.fuzzy_join``.
FEW_QUESTIONS = 10_000


def alike(asked: DataFrame, titles: DataFrame, key: str, floor: float) -> DataFrame:
    """(question_id, key) of trigram similarity of at least ``floor``, of ``asked`` (question_id, codes) and ``titles`` (key, codes), where the
    questions are few (``FEW_QUESTIONS``): each title's trigrams meet the questions that hold them."""
    rows = asked.where(F.size("codes") > 0).collect()
    ids, sizes = np.array([r["question_id"] for r in rows], dtype=np.int64), np.array([len(r["codes"]) for r in rows], dtype=np.int64)
    codes, owner = np.concatenate([np.zeros(0, dtype=np.int64), *(np.array(r["codes"], dtype=np.int64) for r in rows)]), np.repeat(np.arange(len(rows)), sizes)
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at, n = _lists(batch.column(1))
            for start, stop in _parts(n, 20_000):
                own = values.to_numpy()[at[start] : at[start] + n[start:stop].sum()]
                first = np.searchsorted(codes, own)
                met = np.searchsorted(codes, own, side="right") - first
                doc = np.repeat(np.repeat(np.arange(stop - start), n[start:stop]), met)
                both = np.bincount(doc * len(ids) + owner[_ranges(first, met)], minlength=(stop - start) * len(ids)).reshape(stop - start, len(ids)).astype(np.float64)
                d, q = np.nonzero((both > 0) & (both / np.maximum(n[start:stop, None] + sizes - both, 1) >= floor))
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), batch.column(0).take(pa.array(start + d))], names=["question_id", batch.schema.names[0]])

    if not len(ids):
        return titles.select(F.lit(0).cast("long").alias("question_id"), key).where("false")
    return titles.where(F.size("codes") > 0).select(key, "codes").mapInArrow(run, f"question_id long, {key} {dict(titles.dtypes)[key]}")


def few(docs: DataFrame, key: str, asked: DataFrame) -> bool:
    """Whether ``scanned`` can answer: few questions (``FEW_QUESTIONS``), and each question and document has a key of its own."""
    ids = asked.select("question_id").limit(FEW_QUESTIONS + 1).collect()
    if len(ids) > FEW_QUESTIONS or len({r[0] for r in ids} - {None}) < len(ids):
        return False
    return not docs.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).limit(1).collect()


def scanned(docs: DataFrame, key: str, fields: Mapping[str, tuple[Column, str]], asked: DataFrame, dense: bool = False, codes: Column | None = None, floor: float = 0.0, carry: Mapping[str, Column] | None = None) -> DataFrame:
    """F3 to F6 without an index, for few questions (``few``): (question_id, key, tokens, n_tokens, mask, matched, strict) as ``Search.matches`` gives
    them, with both densities as of ``Search.cover_density`` where ``dense``, and the columns to ``carry`` of the documents. With ``codes``, the
    trigrams of titles, and those of questions in ``asked``, also ``similar``, and the pairs of at least ``floor`` whatever they match.

    Documents are read once, and pairs are made and scored where they are: neither terms, positions nor pairs are shuffled.
    """
    spark, carry = docs.sparkSession, dict(carry or {})
    own = [] if codes is None else ["codes"]
    rows = asked.select("question_id", F.array_distinct(F.coalesce("tokens", F.array().cast("array<string>"))).alias("tokens"), *own).collect()
    tokens = sorted({x for r in rows for x in r["tokens"]})
    place = {x: i for i, x in enumerate(tokens)}
    wanted = [[place[x] for x in r["tokens"]] for r in rows]
    kinds = dict(docs.select(key, *(x.alias(n) for n, x in carry.items())).dtypes)
    texts = docs.select(F.col(key), *(F.lower(text).alias(f"_{i}") for i, (text, _) in enumerate(fields.values())), *([] if codes is None else [codes.alias("_codes")]), *(x.alias(n) for n, x in carry.items()))
    schema = ["_question long", *(f"{n} {kinds[n]}" for n in [key, *carry]), "mask int", "matched int", *(["strict_density double", "relaxed_density double"] if dense else []), *(["similar double"] if own else [])]
    found = texts.mapInArrow(_scanning(tokens, wanted, [w for _, w in fields.values()], dense, [r["codes"] or [] for r in rows] if own else None, floor), ", ".join(schema))
    these = spark.createDataFrame([(i, r["question_id"], r["tokens"], len(r["tokens"])) for i, r in enumerate(rows)], f"_question long, question_id {dict(asked.dtypes)['question_id']}, tokens array<string>, n_tokens int")
    full = found.join(F.broadcast(these), "_question").withColumn("strict", (F.col("n_tokens") > 0) & (F.col("matched") == F.col("n_tokens")))
    return full.select("question_id", key, "tokens", "n_tokens", "mask", "matched", "strict", *(["strict_density", "relaxed_density"] if dense else []), *(["similar"] if own else []), *carry)


#: Cells of documents times questions, or question tokens, and trigrams of titles times those of questions that ``scanned`` holds at once.
HELD = 2_000_000


def _scanning(tokens: Sequence[str], wanted: Sequence[Sequence[int]], weights: Sequence[str], dense: bool, codes: Sequence[Sequence[int]] | None, floor: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (key, a text for each weight, trigrams if ``codes``, columns to carry): the pairs with the questions."""
    n_tokens = np.array([len(x) for x in wanted], dtype=np.int64)
    slots = np.full((len(wanted), int(n_tokens.max(initial=0))), len(tokens), dtype=np.int64)  # the token behind the last is held by none
    for i, x in enumerate(wanted):
        slots[i, : len(x)] = x
    need = np.where(n_tokens > 0, np.minimum(n_tokens, 3), slots.shape[1] + 1)
    inverse = np.array([1 / WEIGHTS[w] for w in weights])
    alike = None if codes is None else _alike(codes)
    carried = 1 + len(weights) + (codes is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, HELD // max(1, len(tokens), len(wanted)))
        for batch in (part.slice(at, most) for part in _sliced(batches, len(weights)) for at in range(0, part.num_rows, most)):
            size = batch.num_rows
            coded, doc, position, field = _placed(batch.columns[1 : len(weights) + 1])
            rank, token, start, n = _begun(tokens, coded)
            # hits: a term of a document for each token that begins it
            hit = np.repeat(np.arange(len(rank)), n[rank])
            cell = token[_ranges(start[rank], n[rank])] * size + doc[hit]
            count = np.bincount(cell, minlength=(len(tokens) + 1) * size)
            held = (count > 0).reshape(-1, size)
            matched, mask = np.zeros((len(wanted), size), dtype=np.int8), np.zeros((len(wanted), size), dtype=np.int32)
            for j in range(slots.shape[1]):
                own = held[slots[:, j]]
                matched += own
                mask |= own.astype(np.int32) << j
            keep = matched >= need[:, None]
            if alike:
                similar = alike(batch.column(len(weights) + 1), len(wanted))
                keep |= (similar > 0) & (similar >= floor)
            q, d = np.nonzero(keep)
            out = [pa.array(q), *(batch.column(i).take(pa.array(d)) for i in (0, *range(carried, batch.num_columns))), pa.array(mask[q, d]), pa.array(matched[q, d].astype(np.int32))]
            names = ["_question", *(batch.schema.names[i] for i in (0, *range(carried, batch.num_columns))), "mask", "matched"]
            if dense:
                by = np.argsort(cell, kind="stable")
                hit = hit[by]
                out += map(pa.array, _scores(q, d, slots, n_tokens, matched, need, count, position[hit], inverse[field[hit]], size))
                names += ["strict_density", "relaxed_density"]
            if alike:
                out, names = [*out, pa.array(similar[q, d])], [*names, "similar"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def _scores(q: np.ndarray, d: np.ndarray, slots: np.ndarray, n_tokens: np.ndarray, matched: np.ndarray, need: np.ndarray, count: np.ndarray, position: np.ndarray, inverse: np.ndarray, size: int) -> np.ndarray:
    """Both densities of pairs (q, d), of positions and inverse weights in order of token and document, ``count`` each; 0 under the floor."""
    out = np.zeros((2, len(q)))
    begin = np.cumsum(count) - count
    able = np.flatnonzero(matched[q, d] >= need[q])
    for some in (able[i : i + PAIRS] for i in range(0, len(able), PAIRS)):
        cell = slots[q[some]] * size + d[some, None]
        pair, token = np.nonzero(count[cell])
        cell = cell[pair, token]
        n = count[cell]
        for at, to in _parts(np.bincount(pair, n, minlength=len(some)).astype(np.int64), SCORED):
            e = slice(*np.searchsorted(pair, [at, to]))
            hits = _ranges(begin[cell[e]], n[e])
            out[:, some[at:to]] = _covers(np.repeat(pair[e] - at, n[e]), position[hits], np.repeat(token[e], n[e]), inverse[hits], n_tokens[q[some[at:to]]])
    return out


def _alike(codes: Sequence[Sequence[int]]) -> Callable[[pa.ListArray, int], np.ndarray]:
    """Trigram similarities of the questions of ``codes`` and of lists of trigrams, a row a question."""
    sizes = np.array([len(x) for x in codes], dtype=np.int64)
    known, owner = np.concatenate([np.zeros(0, dtype=np.int64), *(np.array(x, dtype=np.int64) for x in codes)]), np.repeat(np.arange(len(codes)), sizes)
    order = np.argsort(known, kind="stable")
    known, owner = known[order], owner[order]

    def run(column: pa.ListArray, questions: int) -> np.ndarray:
        values, _, n = _lists(column)
        values = values.to_numpy()
        first = np.searchsorted(known, values)
        met = np.searchsorted(known, values, side="right") - first
        doc = np.repeat(np.arange(len(n)), n)
        both = np.zeros(len(n) * questions)
        for at, to in _parts(met, HELD):
            part = np.repeat(doc[at:to], met[at:to]) * questions + owner[_ranges(first[at:to], met[at:to])]
            low = int(doc[at]) * questions
            high = (int(doc[to - 1]) + 1) * questions
            both[low:high] += np.bincount(part - low, minlength=high - low)
        both = both.reshape(len(n), questions).T
        return both / np.maximum(n + sizes[:, None] - both, 1)

    return run


def semantic_floor(found: DataFrame, context: DataFrame, need: int = 2) -> DataFrame:
    """matches in which at least min(``need``, n) of the question's n tokens that are neither generic nor words
    of its context (question_id, words) begin a term; questions without such tokens have no matches."""
    rows = found.join(context.select("question_id", F.col("words").alias("_c")), "question_id", "left")
    own = lambda t: ~t.isin(T.GENERIC_TERMS) & ~F.coalesce(F.array_contains("_c", t), F.lit(False))
    bits = F.transform("tokens", lambda t, i: F.when(own(t), F.pow(F.lit(2), i).cast("int")).otherwise(0))
    rows = rows.withColumn("_own", F.aggregate(bits, F.lit(0), lambda a, b: a + b))
    met = F.bit_count(F.col("_own").bitwiseAND(F.col("mask")))
    return rows.where((F.col("_own") > 0) & (met >= F.least(F.lit(need), F.bit_count("_own")))).drop("_c", "_own")


def network_score(strict: Column, relaxed: Column, similar: Column, confidence: Column, quality: Column, scope: Column) -> Column:
    """F7."""
    bonus = F.when(scope == "model", 0.30).when(scope == "vendor_os", 0.20).when(scope == "architecture", 0.15).otherwise(0.05)
    return strict * 0.70 + relaxed * 0.30 + similar * 0.15 + confidence * 0.10 + quality * 0.10 + bonus


def generic_score(strict: Column, relaxed: Column, title_similar: Column, summary_similar: Column, context: Column) -> Column:
    """F8."""
    return strict * 8 + relaxed * 4 + title_similar * 2 + summary_similar + F.when(context, 3).otherwise(0)


# Order of scopes and of version matches.
SCOPE_ORDER = {"model": 4, "vendor_os": 3, "architecture": 2, "os_family": 1}
VERSION_ORDER = {"exact": 5, "explicit_range": 4, "branch": 3, "unbounded": 2, "same_branch_fallback": 1}


def answer_order(scope: Column, version_match: Column, rank: Column, *ties: Column) -> list[Column]:
    """scope, then version match, then rank."""
    place = lambda table, value: F.desc(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[value])
    return [place(SCOPE_ORDER, scope), place(VERSION_ORDER, version_match), rank.desc(), *ties]


def capped(scored: DataFrame, rank: str, key: str, cap: int = 100, share: float = 0.5, floor: float = 0.01) -> DataFrame:
    """the first ``cap`` of each question, then those of at least ``share`` of the best."""
    w = W.partitionBy("question_id").orderBy(F.desc(rank), key)
    top = scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap)
    best = F.max(rank).over(W.partitionBy("question_id"))
    return top.withColumn("_best", best).where(F.col(rank) >= F.greatest(F.col("_best") * share, F.lit(floor))).drop("_r", "_best")


def final_order(answers: DataFrame, order: Sequence[Column], semantic_key: str, limit: int) -> DataFrame:
    """one answer for each semantic key, in order, with ``place`` up to ``limit``."""
    first = answers.withColumn("_r", F.row_number().over(W.partitionBy("question_id", semantic_key).orderBy(*order))).where("_r = 1")
    return first.withColumn("place", F.row_number().over(W.partitionBy("question_id").orderBy(*order))).where(F.col("place") <= limit).drop("_r")


# Capabilities of a question (pattern, query), in order.
CAPABILITIES = {
    "system-reboot": (r"(?i)\b(?:reboot|reload|restart|перезагруз)", "reboot restart system safely"),
    "ip-configuration": (r"(?i)\b(?:static\s+ip|ip\s+address|address\s+eth|ifconfig|настро(?:ить|йка)\s+ip)", "configure temporary IP address interface netmask gateway"),
    "arp-diagnostics": (r"(?i)\barp\b|address resolution", "inspect ARP neighbor resolution diagnostics"),
    "interface-counters": (r"(?i)\b(?:rx|tx|counter|packet|drop|error|ошибк|сч[её]тчик)", "inspect interface RX TX packet error counters"),
    "tftp-transfer": (r"(?i)\btftp\b", "TFTP get download file BusyBox client"),
    "boot-behavior": (r"(?i)\b(?:boot|booting|startup|загруз)", "boot mode rescue installer behavior"),
    "vlan-trunk": (r"(?i)\b(?:vlan|trunk)\b", "VLAN trunk configuration verification rollback"),
    "port-security": (r"(?i)\b(?:port[- ]security|err[- ]disable|bpdu\s*guard)\b", "port security err-disable diagnosis recovery"),
}


def capabilities(text: Column) -> Column:
    """the capabilities a question asks for, eight at most; without any the question is ``general``."""
    found = F.filter(F.array(*(F.when(text.rlike(p), F.lit(k)) for k, (p, _) in CAPABILITIES.items())), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, F.slice(found, 1, 8)).otherwise(F.array(F.lit("general")))


def supports(answer: Column, capability: Column) -> Column:
    """an answer's text shows the capability; ``general`` needs nothing."""
    out = capability == "general"
    for k, (p, _) in CAPABILITIES.items():
        out = out | ((capability == k) & answer.rlike(p))
    return F.coalesce(out, F.lit(False))


def coverage(parts: DataFrame, answers: DataFrame) -> DataFrame:
    """(question_id, covered, total, status) from parts (question_id, part; repeated ones count once) and their answers.

    Parts and answers are counted together, after one shuffle by question into as many tasks as their number asks for, so that what a
    task holds does not grow with them.
    """
    given = answers.where("question_id is not null and part is not null")
    rows = parts.select("question_id", "part", F.lit(True).alias("_asked")).unionByName(given.select("question_id", "part", F.lit(False).alias("_asked")))
    dealt = rows.repartition(rows.count() // COUNTED + 1, "question_id")
    each = dealt.groupBy("question_id", "part").agg(F.bool_or("_asked").alias("_asked"), F.bool_or(~F.col("_asked")).alias("_has")).where("_asked")
    out = each.groupBy("question_id").agg(F.count_if("_has").alias("covered"), F.count("*").alias("total"))
    return out.withColumn("status", F.when(F.col("covered") == F.col("total"), "complete").when(F.col("covered") > 0, "partial").otherwise("unknown"))


def web_filter(text: Column, wanted: str) -> Column:
    """F16: a list filter: all words and quoted phrases, ``-word`` for absence, ``or`` between alternatives."""
    import re

    low = F.lower(text)
    word = lambda w: low.rlike(r"(^|[^a-z0-9])" + r"[^a-z0-9]+".join(re.findall("[a-z0-9]+", w.lower())) + r"($|[^a-z0-9])")
    out = None
    for side in re.split(r"\s+or\s+", wanted, flags=re.I):
        one = F.lit(True)
        for minus, phrase, plain in re.findall(r'(-?)(?:"([^"]+)"|(\S+))', side):
            if re.search("[a-z0-9]", (phrase or plain).lower()):
                hit = word(phrase or plain)
                one = one & (~hit if minus else hit)
        out = one if out is None else out | one
    return out


def leaked_fields(df: DataFrame, forbidden: Sequence[str]) -> list[str]:
    """forbidden names among the columns of a public frame, nested ones included."""
    found, work = [], [("", df.schema)]
    while work:
        path, schema = work.pop()
        for f in schema.fields:
            if f.name in forbidden:
                found.append(path + f.name)
            kind = getattr(f.dataType, "elementType", f.dataType)
            if hasattr(kind, "fields"):
                work.append((f"{path}{f.name}.", kind))
    return sorted(found)

# Verbs of a question that asks to act, and commands that only read.
ACTION = r"(?i)\b(?:add|apply|back\s+up|backup|change|configure|delete|disable|downgrade|enable|erase|migrate|recover|remove|replace|reset|restore|upgrade)\b"
READS = r"(?i)^(?:dir|display|more|ping|show|traceroute|tracert|verify)\b"


def actionable(answers: DataFrame, question: Column, command: Column, procedure: Column) -> DataFrame:
    """P10: a question that asks to act keeps only answers with a procedure or a command that does more than read."""
    parts = F.filter(F.transform(F.split(F.coalesce(command, F.lit("")), r"[;\n]+"), T.trimmed), lambda x: x != "")
    acts = (F.coalesce(F.size(procedure), F.lit(0)) > 0) | F.exists(parts, lambda x: ~x.rlike(READS))
    return answers.where(~F.coalesce(question.rlike(ACTION), F.lit(False)) | acts)
