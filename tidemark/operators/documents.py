"""Documents to text, pages to links, text to fragments (inventory D, S3, S4)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T

#: Fixed value: largest fragment in bytes.
MAX_BYTES = 8192


def page_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with ``text``; a page without markup stays as it is."""
    return pages.withColumn("text", F.when(F.col(html).rlike("<[^>]+>"), T.html_to_text(F.col(html))).otherwise(F.col(html)))


def page_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, link), distinct canonical https links of each page."""
    out = pages.select(key, F.explode(F.array_distinct(F.transform(T.links(F.col(html)), lambda x: T.canonical_url(x, F.col(url))))).alias("link"))
    return out.where("link is not null")


def without_contents_pages(text: Column) -> Column:
    """Form-feed pages without tables of contents; all, if every page looks like one."""
    plain = F.replace(text, F.lit("\r"), F.lit(""))
    pages = F.split(plain, "\f")
    kept = F.filter(pages, lambda p: ~T.is_contents_page(p))
    kept = F.filter(F.transform(F.when(F.size(kept) > 0, kept).otherwise(pages), T.trimmed), lambda p: p != "")
    return F.when(F.contains(plain, F.lit("\f")), F.array_join(kept, "\n")).otherwise(plain)


def _cut(text: str, limit: int) -> Iterator[str]:
    """A long block in pieces of at most ``limit`` bytes, at a line or word end past the half where there is one."""
    data = text.strip().encode()
    while len(data) > limit:
        end = limit
        while data[end] & 0xC0 == 0x80:  # not inside a character
            end -= 1
        # as the end of a piece, the blank right behind it counts too
        space = max(data.rfind(b"\n", 0, end + 1), data.rfind(b" ", 0, end + 1))
        if space > end / 2:
            end = space
        yield data[:end].decode().strip()
        data = data[end:].decode().strip().encode()
    if data:
        yield data.decode()


def blocks(docs: DataFrame, key: str, text: str = "text", limit: int = MAX_BYTES) -> DataFrame:
    """(key, block_no, part_no, block): text between blank lines, long blocks cut. Only blocks over the
    limit go through Python, each on its own, so a long document doesn't have to fit a batch."""
    def split(docs: DataFrame) -> DataFrame:
        rows = docs.select(key, F.posexplode_outer(F.split(without_contents_pages(F.col(text)), r"\n{2,}")).alias("block_no", "block"))
        return rows.withColumn("block", T.trimmed(F.col("block"))).where("block <> ''")

    fits = F.octet_length("block") <= limit
    small = split(docs).where(fits).select(key, "block_no", F.lit(0).alias("part_no"), "block")
    kind = dict(docs.dtypes)[key]

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, b, i, piece) for k, b, t in zip(f[key], f["block_no"], f["block"], strict=True) for i, piece in enumerate(_cut(t, limit))]
            yield pd.DataFrame(rows, columns=[key, "block_no", "part_no", "block"])

    # no block is longer than its text, so only long texts are split again
    large = split(docs.where(F.octet_length(text) > limit)).where(~fits).mapInPandas(cut, f"{key} {kind}, block_no int, part_no int, block string")
    return small.unionByName(large)


def fragments(docs: DataFrame, key: str, text: str = "text", limit: int = MAX_BYTES) -> DataFrame:
    """(key, ordinal, section_title, content, content_hash).

    Blocks of a section are packed greedily to at most ``limit`` bytes; equal contents of a document are
    kept once, and ordinals count what is kept. A section's blocks are folded in order as one array: a
    section is a part of one document, and the fold holds its text once.
    """
    order = ["block_no", "part_no"]
    rows = blocks(docs, key, text, limit).withColumn("heading", T.is_heading(F.col("block")))
    w = W.partitionBy(key).orderBy(*order)
    rows = rows.withColumn("section", F.count_if(F.col("heading")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = rows.withColumn("title", F.first(F.when(F.col("heading"), F.col("block")), ignorenulls=True).over(W.partitionBy(key, "section")))
    parts = rows.where("not heading").groupBy(key, "section", "title").agg(F.array_sort(F.collect_list(F.struct(*order, "block"))).alias("b"))
    start = F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.lit("").alias("cur"), F.lit(0).alias("bytes"))

    def pack(acc: Column, x: Column) -> Column:
        size = F.octet_length(x["block"])
        full = (acc["bytes"] > 0) & (acc["bytes"] + size + 2 > limit)
        joined = F.when(acc["cur"] == "", x["block"]).otherwise(F.concat(acc["cur"], F.lit("\n\n"), x["block"]))
        return F.struct(F.when(full, F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"]).alias("out"), F.when(full, x["block"]).otherwise(joined).alias("cur"), (F.when(full, 0).otherwise(acc["bytes"]) + size + 2).alias("bytes"))

    packed = parts.select(key, "section", "title", F.posexplode_outer(F.aggregate("b", start, pack, lambda a: F.concat(a["out"], F.array(a["cur"])))).alias("i", "content"))
    packed = packed.where("content <> ''").withColumn("content_hash", T.content_hash(F.col("content")))
    first = packed.withColumn("_r", F.row_number().over(W.partitionBy(key, "content_hash").orderBy("section", "i"))).where("_r = 1")
    ordinal = F.row_number().over(W.partitionBy(key).orderBy("section", "i")) - 1
    return first.select(key, ordinal.alias("ordinal"), F.col("title").alias("section_title"), "content", "content_hash")


def new_fragments(fresh: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Fragments whose (key, ordinal) and (key, hash) aren't stored."""
    return fresh.join(stored.select(key, "ordinal"), [key, "ordinal"], "left_anti").join(stored.select(key, "content_hash"), [key, "content_hash"], "left_anti")


def duplicates_of(docs: DataFrame, key: str, url: str, content_hash: str, order: str) -> DataFrame:
    """(key, duplicate_of, reason): the first document of the same URL, else of the same content."""
    by = lambda c, name: docs.where(F.col(c).isNotNull()).groupBy(c).agg(F.min(F.struct(order, key)).alias(name))
    out = docs.select(key, url, content_hash).join(by(url, "u"), url, "left").join(by(content_hash, "h"), content_hash, "left")
    same_url, same_hash = F.col(f"u.{key}") != F.col(key), F.col(f"h.{key}") != F.col(key)
    reason = F.when(same_url, "final_url").when(same_hash, "content_hash")
    return out.select(key, F.when(same_url, F.col(f"u.{key}")).when(same_hash, F.col(f"h.{key}")).alias("duplicate_of"), reason.alias("reason")).where("reason is not null")


# Links that a collection takes as documents.
WANTED_LINKS = r"(?i)\.(?:pdf|txt)(?:\?|$)|(?:command|configuration|diagnostic|manual|reference|release|advisory|upgrade)"


def discover(found: DataFrame, roots: DataFrame, known: DataFrame, depth: int, links: int, wanted: str = WANTED_LINKS) -> tuple[DataFrame, DataFrame]:
    """The links that collections discover over already fetched pages, and (collection, inserted, duplicates).

    ``roots`` is (collection, domain, url), ``found`` (url, link) of all pages, ``known`` the URLs (url) there already. A
    collection follows the links within its domain down to ``depth``, by level at most ``links`` pages, and takes those
    that look ``wanted``, at most ``links``, by depth and URL. A URL is inserted once, for the first collection by name;
    others, and known ones, are duplicates.
    """
    within = T.same_site(T.host_of(F.col("link")), F.col("domain"))
    first = lambda df, *order: df.withColumn("_r", F.row_number().over(W.partitionBy("collection").orderBy(*order))).where(F.col("_r") <= links).drop("_r")
    frontier = roots.select("collection", "domain", "url").distinct()
    seen, taken = frontier, None
    for d in range(depth + 1):
        new = frontier.join(found, "url").where(within).select("collection", "domain", F.col("link").alias("url")).distinct()
        mine = new.where(F.col("url").rlike(wanted)).select("collection", "url", F.lit(d).alias("depth"))
        taken = mine if taken is None else taken.unionByName(mine)
        if d < depth:
            frontier = first(new.join(seen, ["collection", "url"], "left_anti"), "url")
            seen = seen.unionByName(frontier.select(seen.columns))
    taken = first(taken.groupBy("collection", "url").agg(F.min("depth").alias("depth")), "depth", "url")
    owner = taken.groupBy("url").agg(F.min("collection").alias("owner")).join(known.select("url").distinct().withColumn("_known", F.lit(True)), "url", "left")
    taken = taken.join(owner, "url").select("collection", "url", "depth", ((F.col("collection") == F.col("owner")) & F.col("_known").isNull()).alias("inserted"))
    counts = taken.groupBy("collection").agg(F.count_if("inserted").alias("inserted"), F.count_if(~F.col("inserted")).alias("duplicates"))
    every = roots.select("collection").distinct().join(counts, "collection", "left")
    return taken, every.select("collection", F.coalesce("inserted", F.lit(0)).alias("inserted"), F.coalesce("duplicates", F.lit(0)).alias("duplicates"))


def rejected_for(docs: DataFrame, demands: DataFrame, key: str, demand: str) -> DataFrame:
    """Documents that hold none of their demand's terms, with a reason; without terms none is rejected."""
    terms = demands.select(demand, T.demand_terms(F.col("question")).alias("terms"))
    both = docs.join(terms, demand)
    return both.where(~T.relevant(F.col("text"), F.col("terms"))).select(key, F.lit("DEMAND_TERMS_ABSENT").alias("reason"))


def fragment_scores(frags: DataFrame, terms: DataFrame) -> DataFrame:
    """Fragments by demand with ``score``: four for each term in the title, one for each in the body.
    ``terms`` is (demand_id, source_id, terms)."""
    score = F.size(T.matched_terms(F.coalesce("section_title", F.lit("")), F.col("terms"))) * 4 + F.size(T.matched_terms(F.col("content"), F.col("terms")))
    return frags.join(terms, "source_id").withColumn("score", score)


def top_fragments(scored: DataFrame, n: int) -> DataFrame:
    """The best ``n`` of each demand, ties by source and ordinal."""
    w = W.partitionBy("demand_id").orderBy(F.desc("score"), "source_id", "ordinal")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def top_sources(scored: DataFrame, n: int = 8) -> DataFrame:
    """The best ``n`` sources of each demand by the sum of their fragments' scores."""
    total = scored.groupBy("demand_id", "source_id").agg(F.sum("score").alias("score")).where("score > 0")
    w = W.partitionBy("demand_id").orderBy(F.desc("score"), "source_id")
    return total.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def completed_sources(sources: DataFrame, open_work: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """Sources without open work: completed, or with exceptions where something failed."""
    done = sources.join(open_work.select(key).distinct(), key, "left_anti")
    bad = failed.select(key).distinct().withColumn("_bad", F.lit(True))
    return done.join(bad, key, "left").select(key, F.when(F.col("_bad"), "completed_with_exceptions").otherwise("completed").alias("status"))


def coverage(targets: DataFrame, published: DataFrame, key: str, percent: str) -> DataFrame:
    """Targets with their percent raised by publications (25, or 5 with sources only), at most 100."""
    n = published.groupBy(key).agg(F.count_if(F.col("published")).alias("n"), F.count("*").alias("sources"))
    floor = F.when(F.col("n") > 0, 25).when(F.col("sources") > 0, 5).otherwise(0)
    new = F.least(F.lit(100), F.greatest(F.col(percent), floor))
    status = F.when(F.coalesce("n", F.lit(0)) > 0, "partial").when(F.coalesce("sources", F.lit(0)) > 0, "discovered").otherwise("queued")
    return targets.join(n, key, "left").select(key, new.alias(percent), status.alias("status"))
