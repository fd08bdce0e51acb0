"""Queries over documents and questions on small tables of their own."""

import random
import re
from types import SimpleNamespace

from tidemark.operators import documents as D
from tidemark.plans import documents


def test_discovery_by_collection(spark):
    u = lambda h, p: f"https://{h}.x.com/{p}"
    links = [(u("a", ""), u("a", "one")), (u("a", ""), u("b", "manual-1")), (u("a", ""), "https://other.org/manual"), (u("a", "one"), u("a", "two.pdf")), (u("a", "two.pdf"), u("a", "release-3")), (u("b", ""), u("b", "manual-1")), (u("b", ""), u("a", "known-manual")), (u("b", "manual-1"), u("b", ""))]
    links += [(u("c", ""), u("c", f"manual-{k:02d}")) for k in range(20)]
    found = spark.createDataFrame(links, "url string, link string")
    roots = spark.createDataFrame([(h, "x.com", u(h, "")) for h in "abcd"], "collection string, domain string, url string")
    known = spark.createDataFrame([(u("a", "known-manual"),)], "url string")
    taken, counts = D.discover(found, roots, known, 1, 5)
    assert {(r["collection"], r["inserted"], r["duplicates"]) for r in counts.collect()} == {("a", 2, 0), ("b", 0, 2), ("c", 5, 0), ("d", 0, 0)}
    assert {r["url"] for r in taken.where("collection = 'a'").collect()} == {u("b", "manual-1"), u("a", "two.pdf")}  # release-3 is a level too far
    assert {r["url"] for r in taken.where("collection = 'c'").collect()} == {u("c", f"manual-{k:02d}") for k in range(5)}


def test_every_question_gets_documents(spark):
    word = lambda i: "".join(chr(97 + int(d)) for d in f"{i:04d}")
    items = [(i, f"zz{word(i)} needed") for i in range(90)]
    docs = [(i, f"The zz{word(i % 90)} is here." if i < 180 else "Nothing of it.") for i in range(270)]
    t = SimpleNamespace(benchmark=spark.createDataFrame(items, "item_id long, text string"), documents=spark.createDataFrame(docs, "doc_id long, text string"))
    every = {(i, k) for i in range(90) for k in (i, i + 90)}
    assert {(r["demand_id"], r["source_id"]) for r in documents.d20(t).where("score > 0").collect()} == every
    assert {(r["demand_id"], r["source_id"]) for r in documents.d21(t).collect()} == every
    assert sorted(r["doc_id"] for r in documents.d19(t).collect()) == list(range(180, 270))


def texts_of_blocks():
    """Texts with headings, short and long blocks, blocks over the limit, repeated blocks, in several scripts."""
    rng = random.Random(8)
    word = lambda: rng.choice(["alpha", "béta", "数据", "gamma-delta", "x"])
    block = lambda: " ".join(word() for _ in range(rng.choice([1, 5, 40, 150])))
    made = []
    for _ in range(30):
        parts = [rng.choice(["SECTION ONE", "2.1 Setup", "", block(), block(), block(), block() + "\nsecond line", "word " * 300, "é" * 700]) for _ in range(rng.randrange(0, 14))]
        made.append("\n\n".join(parts) + rng.choice(["", "\n\n\n", "  "]))
    return [*made, "", None, "same\n\nsame\n\nSECTION TWO\n\nsame"]


def is_heading(block):
    return len(block) <= 180 and "\n" not in block and bool(re.search(r"^[A-Z0-9][A-Z0-9 /:_.()-]{5,}$", block) or re.search(r"^[0-9]+(?:\.[0-9]+)*\s+\S", block))


def test_blocks_and_fragments_equal_plain_python(spark):
    """Pieces of long blocks fit and lose nothing; sections are packed greedily; ordinals count what is kept."""
    limit, texts = 400, texts_of_blocks()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = {}
    for r in sorted(D.blocks(docs, "doc_id", limit=limit).collect(), key=lambda r: (r["doc_id"], r["block_no"], r["part_no"])):
        pieces.setdefault(r["doc_id"], {}).setdefault(r["block_no"], []).append(r["block"])
        assert 0 < len(r["block"].encode()) <= limit
    bare = lambda x: re.sub(r"\s+", "", x)
    for i, text in enumerate(texts):
        want = [b.strip() for b in re.split(r"\n{2,}", text or "")]
        got = pieces.get(i, {})
        assert [bare("".join(got[k])) for k in sorted(got)] == [bare(b) for b in want if b]
    want = []
    for i in range(len(texts)):
        title, cur, size, out = None, "", 0, []
        for b in [p for k in sorted(pieces.get(i, {})) for p in pieces[i][k]]:
            if is_heading(b):
                out, title, cur, size = [*out, (title, cur)], b, "", 0
                continue
            n = len(b.encode())
            if size and size + n + 2 > limit:
                out, cur, size = [*out, (title, cur)], "", 0
            cur, size = f"{cur}\n\n{b}" if cur else b, size + n + 2
        kept = []
        for title, content in [*out, (title, cur)]:
            if content and content not in [c for _, c in kept]:
                kept.append((title, content))
        want += [(i, k, title, content) for k, (title, content) in enumerate(kept)]
    got = sorted((r["doc_id"], r["ordinal"], r["section_title"] or "", r["content"]) for r in D.fragments(docs, "doc_id", limit=limit).collect())
    assert got == sorted((i, k, t or "", x) for i, k, t, x in want) and len(got) > 40
