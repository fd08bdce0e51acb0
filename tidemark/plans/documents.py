"""Inventory D, N1 to N4, P8, Q1, Q4, Q5, F1, F5, V over ``pages``, ``documents``, ``conversations`` and ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import versions as V
from ..operators import documents as D
from .registry import Tables, query

c = F.col


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _newlines(text: str) -> str:
    return " || chr(10) || ".join(_q(p) for p in text.split("\n"))


def _html_sql(column: str) -> str:
    for pattern, to in T.HTML_STEPS:
        column = f"regexp_replace({column}, {_q(pattern)}, {_newlines(to)}, 'g')"
    return f"regexp_replace({column}, '^\\s+|\\s+$', '', 'g')"


@query("d1_html_to_text", f"SELECT page_id, {_html_sql('html')} AS text FROM pages")
def d1(t: Tables):
    return D.page_text(t.pages).select("page_id", "text")


_LINK = r"""(?i)<a\b[^>]*\bhref\s*=\s*["'']([^"''#]+)["'']"""


@query("d2_links", f"SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS link FROM pages")
def d2(t: Tables):
    return t.pages.select("page_id", F.explode(T.links(c("html"))).alias("link"))


_CANON = """CASE WHEN regexp_matches(u, '^https://[^/?#]') THEN 'https://' || lower(regexp_extract(u, '^https://([^/?#]*)', 1)) ||
  coalesce(nullif(regexp_replace(regexp_extract(u, '^https://[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g'), ''), '/') ||
  coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(u, '\\?([^#]*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(utm_[^=]*|ref|source|campaign)(=|$)')), '&'), ''), '') END"""


@query("d3_canonical_url", f"SELECT page_id, {_CANON} AS link FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages)")
def d3(t: Tables):
    return t.pages.select("page_id", T.canonical_url(c("url"), c("url")).alias("link"))


@query("d4_same_site", "SELECT page_id FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS h FROM pages) WHERE h = 'example.com' OR ends_with(h, '.example.com')")
def d4(t: Tables):
    return t.pages.where(T.same_site(T.host_of(c("url")), F.lit("example.com"))).select("page_id")


_RULES = " ".join(f"WHEN regexp_matches(p, {_q(a)}) THEN {_q(b)}" for a, b in T.DOCUMENT_TYPES)


@query("d5_document_type", f"SELECT link, CASE {_RULES} ELSE 'official_vendor_document' END AS kind FROM (SELECT link, lower(regexp_extract(link, '^[^?#]*', 0)) AS p FROM (SELECT DISTINCT unnest(regexp_extract_all(html, '{_LINK}', 1)) AS link FROM pages))")
def d5(t: Tables):
    found = t.pages.select(F.explode(T.links(c("html"))).alias("link")).distinct()
    return found.select("link", T.first_match(F.lower(F.regexp_extract("link", "^[^?#]*", 0)), T.DOCUMENT_TYPES, "official_vendor_document").alias("kind"))


@query("d6_title_from_url", "SELECT page_id, coalesce(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '')[-1], 'Official vendor document') AS title FROM pages")
def d6(t: Tables):
    return t.pages.select("page_id", T.title_from_url(c("url")).alias("title"))


@query("d7_discovery")
def d7(t: Tables):
    """A collection a host, its pages as roots; of the two registered names under a host's, the last is its domain."""
    base = t.pages.select("page_id", T.canonical_url(c("url"), c("url")).alias("url"), "html").where("url is not null")
    found = D.page_links(base).join(base, "page_id").select("url", "link").distinct()
    host = T.host_of(c("url"))
    roots = base.select(host.alias("collection"), F.regexp_extract(host, r"[^.]+\.[^.]+$", 0).alias("domain"), "url")
    return D.discover(found, roots, base, 2, 500, r"(?i)/(?:[a-z]{2,4}|.*tion.*)$")[1]


#: Documents as books: a cover, a page of contents for two of three, and the text; the rest has no form feed.
_BOOK = "CASE WHEN doc_id % 3 = 0 THEN text ELSE 'Cover' || chr(12) || CASE WHEN doc_id % 3 = 1 THEN 'Contents' || chr(10) || 'One ....... 1' || chr(10) || 'Two ....... 2' || chr(10) || 'Three ...... iv' || chr(12) ELSE '' END || text END"


@query("d8_contents_pages", f"SELECT doc_id, octet_length(encode(CASE WHEN doc_id % 3 = 0 THEN text WHEN trim(text, ' ' || chr(9) || chr(10)) = '' THEN 'Cover' ELSE 'Cover' || chr(10) || trim(text, ' ' || chr(9) || chr(10)) END))::INT AS bytes FROM documents")
def d8(t: Tables):
    return t.documents.select("doc_id", F.octet_length(D.without_contents_pages(F.expr(_BOOK))).alias("bytes"))


@query("d9_blocks")
def d9(t: Tables):
    return D.blocks(t.documents, "doc_id").select("doc_id", "block_no", "part_no", F.octet_length("block").alias("bytes"))


def _sectioned(t: Tables):
    """Documents as manuals: a numbered title, paragraphs for lines, and a last section in capitals."""
    number = (c("doc_id") % 9).cast("string")
    head, notes = F.concat(F.lit("1."), number, F.lit(" Overview")), F.concat(F.lit("RELEASE NOTES "), number)
    return t.documents.withColumn("text", F.concat_ws("\n\n", head, F.replace("text", F.lit("\n"), F.lit("\n\n")), notes, F.lit("None.")))


_SECTIONED = "SELECT doc_id, '1.' || doc_id % 9 || ' Overview' || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)) || chr(10) || chr(10) || 'RELEASE NOTES ' || doc_id % 9 || chr(10) || chr(10) || 'None.' AS text FROM documents"


@query("d10_headings", f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS b FROM ({_SECTIONED})) WHERE length(b) <= 180 AND (regexp_matches(b, '^[A-Z0-9][A-Z0-9 /:_.()-]{{5,}}$') OR regexp_matches(b, '^[0-9]+(\\.[0-9]+)*\\s+\\S')) GROUP BY 1")
def d10(t: Tables):
    lines = _sectioned(t).select("doc_id", F.explode(F.split("text", "\n")).alias("b")).where(T.is_heading(c("b")))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n"))


@query("d11_fragments")
def d11(t: Tables):
    return D.fragments(_sectioned(t), "doc_id").select("doc_id", "ordinal", "section_title", "content_hash", F.octet_length("content").alias("bytes"))


@query("d12_content_hash", "SELECT doc_id, 'sha256:' || sha256(text) AS content_hash FROM documents")
def d12(t: Tables):
    return t.documents.select("doc_id", T.content_hash(c("text")).alias("content_hash"))


@query("d13_fragment_dedup", "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS ordinal, sha256(b) AS h FROM (SELECT doc_id, b, min(i) AS i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS b, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) GROUP BY 1, 2)")
def d13(t: Tables):
    from pyspark.sql.window import Window as W

    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "b"))
    first = lines.groupBy("doc_id", "b").agg(F.min("i").alias("i"))
    return first.select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("i")) - 1).alias("ordinal"), F.sha2("b", 256).alias("h"))


@query(
    "d14_cross_source_dedup",
    "SELECT doc_id, coalesce(CASE WHEN u <> doc_id THEN u END, h) AS duplicate_of, CASE WHEN u <> doc_id THEN 'final_url' ELSE 'content_hash' END AS reason FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY source, n_chars) AS u, min(doc_id) OVER (PARTITION BY text) AS h FROM documents) WHERE u <> doc_id OR h <> doc_id",
)
def d14(t: Tables):
    rows = t.documents.select("doc_id", F.concat_ws("/", "source", c("n_chars").cast("string")).alias("url"), T.content_hash(c("text")).alias("hash"), c("doc_id").alias("at"))
    return D.duplicates_of(rows, "doc_id", "url", "hash", "at")


@query("d15_command_lines", "SELECT p_partkey, unnest(['show version ' || p_brand, 'configure terminal', 'no ip route 10.0.0.' || p_size]) AS command FROM part")
def d15(t: Tables):
    lines = [F.concat(F.lit("1. show  version "), "p_brand"), F.lit("• configure terminal"), F.lit("Reload is a word that ends a sentence."), F.concat(F.lit("no ip route 10.0.0."), c("p_size").cast("string")), F.concat(F.lit("SHOW version "), "p_brand"), c("p_name")]
    return t.part.select("p_partkey", F.explode_outer(T.command_lines(F.concat_ws("\n", *lines))).alias("command")).where("command is not null")


_TERMS_SQL = f"list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9]*(?:[-_/][a-z0-9]+)*'), lambda x: length(x) BETWEEN 3 AND 64 AND NOT list_contains({T.IGNORED_TERMS}, x) AND NOT regexp_matches(x, '^[a-z]{{1,2}}[0-9]{{2,5}}[a-z0-9-]*$'))"
_DISTINCT = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


@query("d17_demand_terms", f"SELECT conv_id, turn, array_to_string({_DISTINCT.format('w')}[:12], ' ') AS terms FROM (SELECT conv_id, turn, {_TERMS_SQL} AS w FROM conversations WHERE role = 'user')")
def d17(t: Tables):
    return t.conversations.where("role = 'user'").select("conv_id", "turn", F.array_join(T.demand_terms(c("text")), " ").alias("terms"))


def _dealt(t: Tables):
    """(doc_id, item_id): documents dealt to all items, by both ids modulo the number of items."""
    n = F.broadcast(t.benchmark.agg(F.greatest(F.count("*"), F.lit(1)).alias("n")))
    place = lambda rows, key: rows.select(key).crossJoin(n).select(key, F.pmod(key, "n").alias("place"))
    return place(t.documents, "doc_id").join(place(t.benchmark, "item_id"), "place").select("doc_id", "item_id").distinct()


_DEALT = f"""SELECT doc_id, item_id, terms, len(list_filter(terms, lambda x: regexp_matches(t, '(^|[^a-z0-9])' || x || '($|[^a-z0-9])')))::INT AS n_matched
  FROM (SELECT item_id, {_DISTINCT.format('w')}[:12] AS terms FROM (SELECT item_id, {_TERMS_SQL} AS w FROM benchmark)) JOIN (SELECT doc_id, lower(text) AS t FROM documents) ON item_id % (SELECT count(*) FROM benchmark) = doc_id % (SELECT count(*) FROM benchmark)"""


@query("d18_relevance", f"SELECT doc_id, item_id, n_matched, len(terms) AS n_terms FROM ({_DEALT})")
def d18(t: Tables):
    q = t.benchmark.select("item_id", T.demand_terms(c("text")).alias("terms"))
    d = t.documents.select("doc_id", "text").join(_dealt(t), "doc_id").join(q, "item_id")
    return d.select("doc_id", "item_id", F.size(T.matched_terms(c("text"), c("terms"))).alias("n_matched"), F.size("terms").alias("n_terms"))


@query("d19_rejected_documents", f"SELECT doc_id, 'DEMAND_TERMS_ABSENT' AS reason FROM ({_DEALT}) WHERE n_matched = 0 AND len(terms) > 0")
def d19(t: Tables):
    docs = t.documents.select("doc_id", "text").join(_dealt(t), "doc_id")
    return D.rejected_for(docs, t.benchmark.select("item_id", c("text").alias("question")), "doc_id", "item_id")


def _scored(t: Tables):
    frags = D.fragments(_sectioned(t), "doc_id").withColumnRenamed("doc_id", "source_id")
    terms = t.benchmark.select(c("item_id").alias("demand_id"), T.demand_terms(c("text")).alias("terms"))
    each = _dealt(t).select(c("doc_id").alias("source_id"), c("item_id").alias("demand_id"))
    return D.fragment_scores(frags, each.join(terms, "demand_id"))


@query("d20_fragment_ranking")
def d20(t: Tables):
    return D.top_fragments(_scored(t), 10).select("demand_id", "source_id", "ordinal", "score", "place")


@query("d21_source_ranking")
def d21(t: Tables):
    return D.top_sources(_scored(t)).select("demand_id", "source_id", "score", "place")


@query("d22_source_completion", "SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'completed_with_exceptions' ELSE 'completed' END AS status FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O')")
def d22(t: Tables):
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    return D.completed_sources(t.orders.select("o_orderkey"), lines.where("l_linestatus = 'O'"), lines.where("l_returnflag = 'R'"), "o_orderkey")


@query("d23_coverage_rollup", "SELECT c_custkey, least(100, greatest((c_custkey % 40)::BIGINT, CASE WHEN n > 0 THEN 25 WHEN m > 0 THEN 5 ELSE 0 END))::BIGINT AS percent, CASE WHEN n > 0 THEN 'partial' WHEN m > 0 THEN 'discovered' ELSE 'queued' END AS status FROM customer LEFT JOIN (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS n, count(*) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def d23(t: Tables):
    targets = t.customer.select("c_custkey", (c("c_custkey") % 40).cast("long").alias("percent"))
    done = t.orders.select(c("o_custkey").alias("c_custkey"), (c("o_orderstatus") == "F").alias("published"))
    return D.coverage(targets, done, "c_custkey", "percent").select("c_custkey", c("percent").cast("long").alias("percent"), "status")


@query("p8_safe_url", "SELECT page_id, starts_with(url, 'https://') AND NOT contains(regexp_extract(url, '^https://([^/?#]*)', 1), '@') AS safe FROM pages")
def p8(t: Tables):
    return t.pages.select("page_id", T.safe_url(c("url")).alias("safe"))


_KEY = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9._-]+', '-', 'g'), '^[^a-z0-9]+', ''), '[._-]{2,}', '-', 'g'), '[._-]+$', '')"


@query("q1_stable_key", f"SELECT p_partkey, CASE WHEN regexp_matches(k, '^[a-z0-9][a-z0-9._-]{{2,159}}$') THEN k ELSE p_name END AS stable_key FROM (SELECT p_partkey, p_name, {_KEY} AS k FROM part)")
def q1(t: Tables):
    return t.part.select("p_partkey", T.stable_key(c("p_name")).alias("stable_key"))


@query("f1_question_tokens", f"SELECT item_id, array_to_string((CASE WHEN len(k) > 0 THEN k ELSE w END)[:8], ' ') AS tokens FROM (SELECT item_id, w, list_filter({_DISTINCT.format('w')}, lambda x: length(x) >= 2 AND (NOT regexp_matches(x, '^[0-9]+$') OR length(x) >= 3) AND NOT list_contains({T.STOP_WORDS}, x)) AS k FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark))")
def f1(t: Tables):
    return t.benchmark.select("item_id", F.array_join(T.question_tokens(c("text"), {}), " ").alias("tokens"))


_TRI = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query("f5_trigram_similarity", f"SELECT p_partkey, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS sim FROM (SELECT p_partkey, {_TRI.format('p_name')} AS a, {_TRI.format('p_type')} AS b FROM part)")
def f5(t: Tables):
    return t.part.select("p_partkey", F.round(T.similarity(c("p_name"), c("p_type")), 6).alias("sim"))


def _redaction_sql(steps) -> str:
    """A common table for each step: the text after it and the matches that it found."""
    out, counts = ["r0 AS (SELECT doc_id, replace(text, chr(0), '') AS t FROM documents)"], {}
    for k, (kind, pattern, to) in enumerate(steps, start=1):
        have = "".join(f", n{i}" for i in range(1, k))
        to = to.replace("$1", "\\1")
        out.append(f"r{k} AS (SELECT doc_id, regexp_replace(t, {_q(pattern)}, {_q(to)}, 'g') AS t{have}, len(regexp_extract_all(t, {_q(pattern)})) AS n{k} FROM r{k - 1})")
        counts.setdefault(kind, []).append(f"n{k}")
    return f"WITH {', '.join(out)} SELECT doc_id, sha256(t) AS clean_sha256, {', '.join(f'({" + ".join(n)})::INT AS {kind}' for kind, n in counts.items())} FROM r{len(steps)}"


@query("n1_redaction", _redaction_sql(T.SECRET_STEPS))
def n1(t: Tables):
    clean, counts = T.redacted(c("text"), strict=False)
    return t.documents.select("doc_id", F.sha2(clean, 256).alias("clean_sha256"), *(n.alias(k) for k, n in counts.items()))


@query("n2_strict_redaction")
def n2(t: Tables):
    clean, counts = T.redacted(c("text"), strict=True)
    return t.documents.select("doc_id", F.sha2(clean, 256).alias("clean_sha256"), *(n.alias(k) for k, n in counts.items()))


@query("n3_redaction_counts", r"SELECT sum(len(regexp_extract_all(text, '(?i)\b(?:[0-9a-f]{2}[:-]){5}[0-9a-f]{2}\b|\b[0-9a-f]{4}\.[0-9a-f]{4}\.[0-9a-f]{4}\b')))::BIGINT AS macs FROM documents")
def n3(t: Tables):
    _, counts = T.redacted(c("text"), strict=True)
    return t.documents.agg(F.sum(counts["mac_address"]).alias("macs"))


_KINDS = " ".join(f"WHEN regexp_matches(text, {_q(a)}) THEN {_q(b)}" for a, b in T.SNAPSHOT_TYPES)


@query("n4_text_type", f"SELECT conv_id, turn, CASE {_KINDS} ELSE 'other' END AS kind FROM conversations")
def n4(t: Tables):
    return t.conversations.select("conv_id", "turn", T.snapshot_type(c("text")).alias("kind"))


# --- versions: "17.<size>.<key>" from part ---------------------------------------------

_V = "'17.' || p_size || '.' || p_partkey % 30"


def _version():
    return F.concat(F.lit("17."), c("p_size").cast("string"), F.lit("."), (c("p_partkey") % 30).cast("string"))


@query("v1_version_parts", f"SELECT p_partkey, array_to_string(list_transform(regexp_extract_all({_V}, '[0-9]+'), lambda x: x::BIGINT), ',') AS parts FROM part")
def v1(t: Tables):
    return t.part.select("p_partkey", F.array_join(V.parts(_version()).cast("array<string>"), ",").alias("parts"))


@query("v2_version_order", f"SELECT p_partkey, CASE WHEN v < [17, 20, 0] THEN -1 WHEN v > [17, 20, 0] THEN 1 ELSE 0 END AS cmp FROM (SELECT p_partkey, list_transform(regexp_extract_all({_V}, '[0-9]+'), lambda x: x::INT) AS v FROM part)")
def v2(t: Tables):
    return t.part.select("p_partkey", V.compare(V.parts(_version()), V.parts(F.lit("17.20"))).alias("cmp"))


@query("v3_range_applicability", f"SELECT p_partkey FROM (SELECT p_partkey, list_transform(regexp_extract_all({_V}, '[0-9]+'), lambda x: x::INT) AS v FROM part) WHERE v >= [17, 10, 5] AND (p_partkey % 2 = 0 OR v <= [17, 30, 0])")
def v3(t: Tables):
    high = F.when(c("p_partkey") % 2 != 0, V.parts(F.lit("17.30")))
    return t.part.where(V.applicable(V.parts(_version()), V.parts(F.lit("17.10.5")), high)).select("p_partkey")


@query("v4_branch", f"SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '17.' || p_size WHEN 1 THEN '17.' || p_size END AS branch FROM part")
def v4(t: Tables):
    k = c("p_partkey") % 3
    return t.part.select("p_partkey", V.branch(_version(), F.when(k == 0, "calendar").when(k == 1, "semantic").otherwise("vendor")).alias("branch"))


_MATCH = """CASE WHEN s = 'unbounded' THEN 'unbounded' WHEN p_partkey % 11 = 0 THEN 'branch' WHEN s = 'range' THEN CASE WHEN p_size BETWEEN 10 AND 29 OR (p_size = 30 AND p_partkey % 30 = 0) THEN 'explicit_range' END
  WHEN s = 'branch' THEN CASE WHEN p_size = 20 THEN 'branch' END WHEN p_size = 20 THEN 'same_branch_fallback' END"""
_SCOPE = "CASE p_partkey % 4 WHEN 0 THEN 'unbounded' WHEN 1 THEN 'range' WHEN 2 THEN 'branch' ELSE 'exact' END AS s"


def _matched(t: Tables):
    k = c("p_partkey") % 4
    scope = F.when(k == 0, "unbounded").when(k == 1, "range").when(k == 2, "branch").otherwise("exact")
    asked = F.when(c("p_partkey") % 11 != 0, _version())
    return t.part.withColumn("m", V.match(asked, V.parts(F.lit("17.10")), V.parts(F.lit("17.30")), scope, F.lit("17.20"), F.lit("major_minor")))


@query("v5_match", f"SELECT p_partkey, {_MATCH} AS m FROM (SELECT *, {_SCOPE} FROM part)")
def v5(t: Tables):
    return _matched(t).select("p_partkey", "m")


@query("v6_assurance", f"SELECT p_partkey, CASE WHEN m = 'same_branch_fallback' THEN 'best_effort' WHEN p_size % 2 = 0 THEN 'generic' ELSE 'compatible' END AS assurance, CASE WHEN p_size % 2 = 0 THEN 'os_family' ELSE 'exact_model' END AS level FROM (SELECT *, {_MATCH} AS m FROM (SELECT *, {_SCOPE} FROM part)) WHERE m IS NOT NULL")
def v6(t: Tables):
    scope = F.when(c("p_size") % 2 == 0, "os_family").otherwise("model")
    return _matched(t).where("m is not null").select("p_partkey", V.assurance(scope, c("m")).alias("assurance"), V.match_level(scope).alias("level"))


@query("v7_platform_confirmation", "SELECT p_partkey, p_size % 2 = 0 OR p_size > 40 AS confirm, (CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size > 40 THEN 1 ELSE 0 END)::INT AS n_notes FROM part")
def v7(t: Tables):
    from ..operators import relational as R

    notes = {"scope": (c("p_size") % 2 == 0, "Confirm the platform."), "branch": (c("p_size") > 40, "Verified on another release of the branch.")}
    out = R.public_projection(t.part, ["p_partkey"], notes)
    return out.select("p_partkey", (F.size("limitations") > 0).alias("confirm"), F.size("limitations").alias("n_notes"))


@query("v8_family_slug", "SELECT p_partkey, CASE WHEN length(s) <= 55 THEN s ELSE left(s, 55) || '-' || left(sha256(p_brand || chr(0) || p_type || ' ' || p_name || ' ' || p_name), 7) END AS slug FROM (SELECT *, left(regexp_replace(regexp_replace(lower(p_brand || '-' || p_type || ' ' || p_name || ' ' || p_name), '[^a-z0-9-]+', '-', 'g'), '^-+|-+$', '', 'g'), 63) AS s FROM part)")
def v8(t: Tables):
    return t.part.select("p_partkey", V.family_slug(c("p_brand"), F.concat_ws(" ", "p_type", "p_name", "p_name")).alias("slug"))


@query("v9_semantic_key", "SELECT p_partkey, sha256(trim(regexp_replace(lower(p_brand || chr(0) || CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 3 = 1 THEN p_name || chr(10) || p_type ELSE p_name END), '\\s+', ' ', 'g'))) AS key FROM part")
def v9(t: Tables):
    k = c("p_partkey") % 3
    steps = F.when(k == 1, F.array("p_name", "p_type")).otherwise(F.expr("cast(array() as array<string>)"))
    return t.part.select("p_partkey", V.semantic_key(c("p_brand"), F.when(k == 0, c("p_type")), F.lit(None).cast("string"), steps, c("p_name")).alias("key"))


@query("v16_support_counts", "SELECT count(DISTINCT p_brand) AS recognised, count(DISTINCT CASE WHEN p_size > 25 THEN p_brand END) AS deep FROM part")
def v16(t: Tables):
    return t.part.agg(F.countDistinct("p_brand").alias("recognised"), F.countDistinct(F.when(c("p_size") > 25, c("p_brand"))).alias("deep"))


_OWN = r"list_filter(list_transform(string_split(regexp_replace(text, '\r', '', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '^[+-]\s?', ''), ' ' || chr(9) || chr(13))), lambda x: x <> '')"
_READS = " OR ".join(f"regexp_matches(x, {_q(p)})" for p in T.READ_ONLY)
_LEVELS = " ".join(f"WHEN regexp_matches(array_to_string(own, chr(10)), {_q(p)}) THEN {_q(k)}" for p, k in T.RISK_PATTERNS)
_RANK = f"CASE risk {' '.join(f'WHEN {_q(k)} THEN {v}' for k, v in T.RISK_PRIORITY.items())} END"
#: Commands of a change by part: some only read, some change, some destroy.
_CHANGE = "CASE p_size % 7 WHEN 0 THEN 'show version' || chr(10) || 'ping 10.0.0.' || p_size WHEN 1 THEN 'configure terminal' || chr(10) || 'interface eth' || p_size WHEN 2 THEN 'reload' WHEN 3 THEN '+ write erase' WHEN 4 THEN 'delete flash:' || p_name WHEN 5 THEN 'ip link show' ELSE 'do ' || p_name END"


@query("q4_risk", f"SELECT p_partkey, risk, CASE WHEN {_RANK} > 2 THEN risk ELSE 'changes_config' END AS escalated FROM (SELECT p_partkey, CASE WHEN len(own) > 0 AND len(list_filter(own, lambda x: NOT ({_READS}))) = 0 THEN 'safe_read_only' {_LEVELS} ELSE 'unknown' END AS risk FROM (SELECT p_partkey, {_OWN} AS own FROM (SELECT p_partkey, {_CHANGE} AS text FROM part)))")
def q4(t: Tables):
    lines = F.split(F.expr(_CHANGE.replace("chr(10)", "'\\n'").replace(" || p_size", " || cast(p_size as string)")), "\n")
    return t.part.select("p_partkey", T.risk(lines).alias("risk"), T.escalated(F.lit("changes_config"), T.risk(lines)).alias("escalated"))
