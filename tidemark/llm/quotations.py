"""Chat formatting by quotation linking.

Lines that begin with ``>`` are quotes; the number of signs is the quote level. Quoted passages
(runs of lines of one level) are cut to units: the whole, its paragraphs, lines and sentences, white space and line
breaks made one. Units are hashed and joined to the messages of the same conversation whose own words contain an
equal unit, so a part of a paragraph or one that was wrapped again links by its sentences. The message that first said a
unit is its original; a message replies to the original of most quoted words at level 1, else to the last turn before it.

Messages are ordered depth first over replies, the answers to a message by turn. The order comes from the tour that enters
and leaves every message: each step of it points to the next, and pointers that double their reach sum
the entries that are left, so no task needs a whole conversation and the rounds grow with the logarithm of the longest.
Everything runs on built-in functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import Scratch

_QUOTE = r"^((?:[ \t]?>)+)[ \t]?"
#: Turns to a block where the turn before is looked up.
BLOCK = 1024
_QUOTES = "array<struct<level:int,text:string,turn:bigint>>"


def normalised(text: Column) -> Column:
    """Lower case, white space collapsed, no quote or list signs or closing punctuation at the ends."""
    one = F.regexp_replace(F.lower(text), r"\s+", " ")
    return F.regexp_replace(F.regexp_replace(one, r"^[\s>*\-]+", ""), r"[\s.,;:!?]+$", "")


def parsed(text: Column) -> Column:
    """Lines as (level, text); level 0 is the author's own."""
    def line(x: Column) -> Column:
        signs = F.regexp_extract(x, _QUOTE, 1)
        return F.struct(F.length(F.regexp_replace(signs, "[^>]", "")).alias("level"), F.regexp_replace(x, _QUOTE, "").alias("text"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n", -1), line)


def passages(lines: Column) -> Column:
    """Runs of quoted lines of one level, as (level, text)."""
    start = F.struct(F.expr("cast(array() as array<struct<level:int,text:string>>)").alias("out"), F.lit(0).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        size = F.size(acc["out"])
        grown = F.concat(F.slice(acc["out"], F.lit(1), F.greatest(size - 1, F.lit(0))), F.array(F.struct(x["level"].alias("level"), F.concat(F.get(acc["out"], size - 1)["text"], F.lit("\n"), x["text"]).alias("text"))))
        fresh = F.concat(acc["out"], F.array(F.struct(x["level"].alias("level"), x["text"].alias("text"))))
        out = F.when(x["level"] == 0, acc["out"]).when((x["level"] == acc["last"]) & (size > 0), grown).otherwise(fresh)
        return F.struct(out.alias("out"), x["level"].alias("last"))

    return F.aggregate(lines, start, step, lambda acc: acc["out"])


def _units(text: Column) -> Column:
    """The whole text, its paragraphs, lines and sentences, normalised, without empty ones, each once."""
    paragraphs = F.split(text, r"\n[ \t]*\n")
    sentences = F.flatten(F.transform(paragraphs, lambda p: F.split(F.regexp_replace(p, r"\s+", " "), r"(?<=[.!?。！？]) ?")))
    parts = F.concat(F.array(text), paragraphs, F.split(text, r"\n"), sentences)
    return F.array_distinct(F.filter(F.transform(parts, normalised), lambda u: F.length(u) > 0))


def _before(rows: DataFrame, keys: list[str], at: str, name: str) -> DataFrame:
    """Distinct ``rows`` (keys, at) with ``name``: the largest ``at`` under their own. A key's rows are dealt to blocks; what a
    block's first row lacks is the largest of the blocks before, of which there is one row each."""
    dealt = rows.withColumn("_block", F.floor(F.col(at) / BLOCK))
    inside = F.lag(at).over(W.partitionBy(*keys, "_block").orderBy(at))
    last = dealt.groupBy(*keys, "_block").agg(F.max(at).alias("_last"))
    carry = last.withColumn("_carry", F.lag("_last").over(W.partitionBy(*keys).orderBy("_block"))).drop("_last")
    return dealt.withColumn("_in", inside).join(carry, [*keys, "_block"]).select(*keys, at, F.coalesce("_in", "_carry").alias(name))


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: ids, ``role``, ``body`` (without quotes), ``n_quotes`` (passages), ``quotes`` (level, text, and the
    original's turn or null), ``parent_turn`` and ``place``.

    A conversation's messages are in reply order by ``place``: the turn itself where no reply leaves the order of turns, else the
    first turn plus the number of turns that come before. Null and empty texts have an empty body and quote nothing. A
    message without a turn or a conversation has no parent and no place. Repeated rows of a turn each come back, and
    quote or are quoted as one. A quote that the conversation doesn't hold, or only later, links
    nothing. The first turn has no parent; missing turns are passed over. Other columns are ignored.
    """
    src = messages.select(F.col(conv_col).alias("_conv"), F.col(turn_col).cast("long").alias("_turn"), F.col(role_col).alias("role"), F.col(text_col).alias("_text"))
    quoting = F.coalesce(F.col("_text"), F.lit("")).rlike(r"(?md)" + _QUOTE)
    lines = F.when(quoting, parsed(F.col("_text")))
    own = F.when(quoting, F.array_join(F.transform(F.filter(F.col("_lines"), lambda x: x["level"] == 0), lambda x: x["text"]), "\n")).otherwise(F.coalesce("_text", F.lit("")))
    rows = src.withColumn("_lines", lines)
    rows = rows.select("_conv", "_turn", "role", F.trim(F.regexp_replace(own, r"\n{3,}", "\n\n"), F.lit(" \t\r\n")).alias("body"), F.when(quoting, passages(F.col("_lines"))).alias("_quotes"))
    scratch = Scratch(messages.sparkSession, "quotes")
    rows = scratch.save(rows, "rows")

    turns = _before(rows.select("_conv", "_turn").where("_conv is not null and _turn is not null").distinct(), ["_conv"], "_turn", "_prev")
    quoted = rows.where("_quotes is not null and _conv is not null and _turn is not null")
    if quoted.isEmpty():  # then every message answers the last turn before it
        base = rows.join(turns, ["_conv", "_turn"], "left").select("_conv", "_turn", "role", "body", F.expr(f"cast(array() as {_QUOTES})").alias("quotes"), F.col("_prev").alias("parent_turn"), F.when(F.col("_conv").isNotNull(), F.col("_turn")).alias("place"))
    else:
        lists, parent = _originals(rows, quoted)
        linked = scratch.save(turns.join(parent, ["_conv", "_turn"], "left").select("_conv", "_turn", "_prev", F.coalesce("_linked", "_prev").alias("parent_turn")), "parents")
        placed = linked.join(_places(linked, scratch), ["_conv", "_turn"], "left").select("_conv", "_turn", "parent_turn", F.coalesce("_place", "_turn").alias("place"))
        base = rows.join(lists, ["_conv", "_turn"], "left").join(placed, ["_conv", "_turn"], "left")
        base = base.withColumn("quotes", F.coalesce("quotes", F.expr(f"cast(array() as {_QUOTES})")))
    return base.select(F.col("_conv").alias(conv_col), F.col("_turn").alias(turn_col), "role", "body", F.size("quotes").cast("long").alias("n_quotes"), "quotes", "parent_turn", "place")


def _originals(rows: DataFrame, quoted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, turn, quotes) with the turn of each passage's original, and (conv, turn, _linked) of messages whose level 1 links."""
    units = quoted.select("_conv", "_turn", F.explode("_quotes").alias("q")).select("_conv", "_turn", F.col("q.level").alias("level"), F.col("q.text").alias("text"), F.explode(_units(F.col("q.text"))).alias("unit"))
    units = units.withColumn("_hash", F.sha2("unit", 256)).withColumn("_words", F.size(F.split("unit", " ")))
    said = rows.join(quoted.select("_conv").distinct(), "_conv", "left_semi").where("_turn is not null")
    said = said.select("_conv", "_turn", F.explode(_units(F.col("body"))).alias("unit")).groupBy("_conv", F.sha2("unit", 256).alias("_hash")).agg(F.min("_turn").alias("_said"))
    found = units.join(said, ["_conv", "_hash"]).where("_said < _turn")
    votes = found.groupBy("_conv", "_turn", "level", "text", "_said").agg(F.sum("_words").alias("w"))
    best = votes.groupBy("_conv", "_turn", "level", "text").agg(F.max(F.struct("w", "_said")).alias("m")).select("_conv", "_turn", "level", "text", F.col("m._said").alias("turn"))
    parent = votes.where("level = 1").groupBy("_conv", "_turn", "_said").agg(F.sum("w").alias("w")).groupBy("_conv", "_turn").agg(F.max(F.struct("w", "_said")).alias("m")).select("_conv", "_turn", F.col("m._said").alias("_linked"))
    each = quoted.select("_conv", "_turn", F.explode("_quotes").alias("q")).select("_conv", "_turn", "q.level", "q.text").distinct().join(best, ["_conv", "_turn", "level", "text"], "left")
    # a turn's quotes are parts of one message, so this list is no larger than the message
    return each.groupBy("_conv", "_turn").agg(F.array_sort(F.collect_list(F.struct("level", "text", "turn"))).alias("quotes")), parent


def _places(linked: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, turn, _place) in conversations where some reply leaves the order of turns: the first turn plus the number of turns
    before in the depth-first order. ``linked`` is (_conv, _turn, _prev, parent_turn), each turn once."""
    moved = linked.where("not (parent_turn <=> _prev)").select("_conv").distinct()
    nodes = scratch.save(linked.join(moved, "_conv", "left_semi").select("_conv", "_turn", "parent_turn"), "nodes")
    longest = nodes.groupBy("_conv").agg(F.count("*").alias("n"), F.min("_turn").alias("_first"))
    most = longest.agg(F.max("n")).first()[0]
    if most is None:
        return nodes.select("_conv", "_turn", F.lit(None).cast("long").alias("_place"))
    # steps of the tour: (turn, 0) enters a message, (turn, 1) leaves it
    children = _before(nodes.where("parent_turn is not null"), ["_conv", "parent_turn"], "_turn", "_older")
    ends = children.groupBy("_conv", "parent_turn").agg(F.min("_turn").alias("_eldest"), F.max("_turn").alias("_youngest"))
    step = lambda turn, side: F.struct(F.col(turn).alias("turn"), F.lit(side).alias("side"))
    own = nodes.join(ends.select("_conv", F.col("parent_turn").alias("_turn"), "_eldest"), ["_conv", "_turn"], "left")
    enter = own.select("_conv", step("_turn", 0).alias("at"), F.when(F.col("_eldest").isNotNull(), step("_eldest", 0)).otherwise(step("_turn", 1)).alias("next"), F.lit(1).cast("long").alias("n"))
    aside = children.where("_older is not null").select("_conv", step("_older", 1).alias("at"), step("_turn", 0).alias("next"), F.lit(0).cast("long").alias("n"))
    up = ends.select("_conv", step("_youngest", 1).alias("at"), step("parent_turn", 1).alias("next"), F.lit(0).cast("long").alias("n"))
    tour = scratch.save(enter.unionByName(aside).unionByName(up), "tour-0")  # the last step, that leaves the first turn, isn't in it
    rounds = math.ceil(math.log2(2 * most + 1))
    for k in range(0, rounds, 2):  # two doublings to a table
        for _ in range(min(2, rounds - k)):
            ahead = tour.select("_conv", F.col("at").alias("next"), F.col("next").alias("_next"), F.col("n").alias("_n"))
            tour = tour.join(ahead, ["_conv", "next"], "left").select("_conv", "at", F.col("_next").alias("next"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"))
        tour = scratch.save(tour, f"tour-{k + 2}")
        scratch.drop(f"tour-{k}")
    entered = tour.where("at.side = 0").select("_conv", F.col("at.turn").alias("_turn"), "n")
    left = entered.join(longest.select("_conv", F.col("n").alias("_all"), "_first"), "_conv")
    return left.select("_conv", "_turn", (F.col("_first") + F.col("_all") - F.col("n")).alias("_place"))


def chat(linked: DataFrame, role_col: str = "role") -> Column:
    """The message in chat form; a null role reads ``unknown``."""
    return F.concat(F.lit("<|"), F.coalesce(F.col(role_col), F.lit("unknown")), F.lit("|>\n"), F.col("body"), F.lit("\n<|end|>"))
