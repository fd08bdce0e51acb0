"""The subpackage's registered queries and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, filter_audit, fingerprints, language, mixing, near_dedup, neighbours, quotations, secrets, sharding, toxicity, warc
from .shared import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.translate("text", UPPER, LOWER).alias("text"))
    return near_dedup.near_duplicates(docs)


_WORDS_1 = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+')"

OP1_SQL = rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS_1} AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
                         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 75 * (x.n + y.n - same)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""

def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS_2 = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce({_WORDS_2}, []) AS w FROM documents),
b AS MATERIALIZED (SELECT item_id, {_WORDS_2} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS MATERIALIZED (
  SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS g
  FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM (SELECT item_id, w, least(10, len(w)) AS l FROM b WHERE len(w) > 0))),
dw AS MATERIALIZED (
  SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS g
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw) x WHERE len(w) >= l)),
h AS MATERIALIZED (SELECT doc_id, i, dw.l, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.l = bw.l),
p AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS i FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(p.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
       sha256(coalesce(t.s, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = language.train(docs.where(~held_out))
    return language.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.grade(docs, model).select("doc_id", "severity", "grade", "toxic")


#: Sources fall into four domains by their number; the rest of the weights by level and value.
DOMAIN_WEIGHTS = {"d0": 0.4, "d1": 0.3, "d2": 0.2, "d3": 0.1, "*": 0.1}
LANG_WEIGHTS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1, "*": 0.05}
MIX_WEIGHTS = {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS}
MIX_FRACTION, MIX_EPOCHS, MIX_SEED = 1.0, 4, 1


def domain_column():
    return F.concat(F.lit("d"), (F.coalesce(F.regexp_extract("source", r"([0-9]+)$", 1).try_cast("long"), F.lit(0)) % 4).cast("string"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    tree = {"domain": domain_column(), "lang": F.col("lang"), "source": F.col("source")}
    out = mixing.mix(docs, tree, MIX_WEIGHTS, MIX_FRACTION, MIX_EPOCHS, MIX_SEED)
    return out.select("doc_id", "epoch", "n_tokens")


def _weights_sql(column: str, weights: dict[str, float]) -> str:
    return f"CASE {' '.join(f"WHEN {column} = '{k}' THEN {v}::DOUBLE" for k, v in weights.items() if k != '*')} ELSE {weights['*']}::DOUBLE END"


def _level_sql(name: str, cols: list[str], weight: str, above: str) -> str:
    parent = ", ".join(cols[:-1])
    over = f"PARTITION BY {parent} " if parent else ""
    keep = f"USING ({parent})" if parent else "ON true"
    return rf"""
{name}_n AS (SELECT {", ".join("b." + c for c in cols)}, b.cap, {weight.replace("$", "b." + cols[-1])} AS w, p.got AS budget
  FROM (SELECT {", ".join(cols)}, sum(cap) AS cap FROM leaf GROUP BY {", ".join(cols)}) b JOIN {above} p {keep}),
{name}_o AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre,
  sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wt, row_number() OVER o AS pos
  FROM {name}_n WINDOW o AS ({over}ORDER BY cap / w, {cols[-1]})),
{name}_f AS (SELECT *, cap <= (budget - pre) / wt * w AS is_full FROM {name}_o),
{name}_r AS (SELECT *, min(CASE WHEN NOT is_full THEN pos END) OVER ({over}) AS first_open FROM {name}_f),
{name}_g AS (SELECT *, max(CASE WHEN pos = first_open THEN (budget - pre) / wt END) OVER ({over}) AS rate FROM {name}_r),
{name} AS MATERIALIZED (SELECT {", ".join(cols)}, CASE WHEN is_full THEN cap ELSE least(cap, rate * w) END AS got FROM {name}_g)"""


OP4_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')), 0)::BIGINT AS t,
         'd' || (coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT), 0) % 4)::VARCHAR AS a,
         coalesce(lang, '(null)') AS b, coalesce(source, '(null)') AS c FROM documents),
leaf AS MATERIALIZED (SELECT a, b, c, sum(t)::BIGINT AS t, sum(t)::DOUBLE * {MIX_EPOCHS} AS cap FROM d GROUP BY a, b, c),
root AS (SELECT least(sum(t) * {MIX_FRACTION}::DOUBLE, sum(cap)) AS got FROM leaf),
{_level_sql("l1", ["a"], _weights_sql("$", DOMAIN_WEIGHTS), "root")},
{_level_sql("l2", ["a", "b"], _weights_sql("$", LANG_WEIGHTS), "l1")},
{_level_sql("l3", ["a", "b", "c"], "1::DOUBLE", "l2")},
q AS (SELECT leaf.*, floor(got + 1e-6)::BIGINT AS g, least(floor((got + 1e-6) / t), {MIX_EPOCHS})::BIGINT AS e FROM leaf JOIN l3 USING (a, b, c)),
h AS (SELECT d.*, e, g - e * q.t AS rest,
  ('0x' || substr(sha256('{MIX_SEED}:' || (e + 1)::VARCHAR || ':' || doc_id::VARCHAR), 1, 15))::BIGINT AS k FROM d JOIN q USING (a, b, c)),
r AS (SELECT *, sum(t) OVER (PARTITION BY a, b, c ORDER BY k, doc_id) AS run FROM h),
n AS (SELECT doc_id, t, e + (rest > 0 AND run <= rest)::BIGINT AS n FROM r)
SELECT doc_id, unnest(range(1, n + 1)) AS epoch, t AS n_tokens FROM n WHERE n > 0
"""

def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs))
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secrets.span_list(base), 256).alias("base_sha256"), secrets.span_list(F.col("secrets")).alias("spans")
    )


def op6_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = quotations.link(table(spark, sf_dir, "conversations"))
    return linked.select("conv_id", "turn", "role", "n_quotes", "parent_turn", "place", quotations.chat(linked).alias("chat"))


_SIGNS = r"'^((?:[ \t]?>)+)[ \t]?'"

OP6_SQL = rf"""
WITH RECURSIVE m AS MATERIALIZED (SELECT row_number() OVER () AS rid, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
l AS MATERIALIZED (SELECT rid, conv_id, turn, i, length(regexp_replace(regexp_extract(x, {_SIGNS}, 1), '[^>]', '', 'g')) AS level, regexp_replace(x, {_SIGNS}, '') AS x
  FROM (SELECT *, unnest(string_split_regex(text, '\r?\n')) AS x, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS i FROM m)),
own AS (SELECT m.rid, trim(regexp_replace(CASE WHEN max(level) > 0 THEN coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE level = 0), '') ELSE any_value(text) END, '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS body
  FROM m JOIN l ON l.rid = m.rid GROUP BY m.rid),
p AS MATERIALIZED (SELECT rid, conv_id, turn, run, level, string_agg(x, chr(10) ORDER BY i) AS text
  FROM (SELECT *, sum(turned) OVER (PARTITION BY rid ORDER BY i) AS run FROM (SELECT *, (level IS DISTINCT FROM lag(level) OVER (PARTITION BY rid ORDER BY i))::INT AS turned FROM l))
  WHERE level > 0 AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2, 3, 4, 5),
tx AS (SELECT conv_id, turn, level, text, run, rid FROM p UNION ALL SELECT conv_id, turn, 0, body, 0, m.rid FROM m JOIN own ON own.rid = m.rid),
u AS MATERIALIZED (SELECT conv_id, turn, level, text, run, rid, unnest(list_distinct(list_filter(list_transform(parts, lambda x:
    regexp_replace(regexp_replace(regexp_replace(lower(x), '\s+', ' ', 'g'), '^[\s>*\-]+', ''), '[\s.,;:!?]+$', '')), lambda x: x <> ''))) AS unit
  FROM (SELECT *, list_concat([text], string_split_regex(text, '\n[ \t]*\n'), string_split(text, chr(10)), flatten(list_transform(string_split_regex(text, '\n[ \t]*\n'), lambda q:
    string_split(regexp_replace(regexp_replace(q, '\s+', ' ', 'g'), '([.!?。！？]) ?', '\1' || chr(1), 'g'), chr(1))))) AS parts FROM tx)),
said AS MATERIALIZED (SELECT conv_id, unit, min(turn) AS said FROM u WHERE level = 0 AND turn IS NOT NULL GROUP BY 1, 2),
votes AS (SELECT u.conv_id, u.turn, said, sum(len(string_split(u.unit, ' '))) AS w FROM u JOIN said ON said.conv_id = u.conv_id AND said.unit = u.unit WHERE level = 1 AND said < u.turn GROUP BY 1, 2, 3),
linked AS (SELECT conv_id, turn, max((w, said)) AS best FROM votes GROUP BY 1, 2),
par AS MATERIALIZED (SELECT t.conv_id, t.turn, prev, coalesce(best[2], prev) AS parent_turn
  FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM (SELECT DISTINCT conv_id, turn FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL)) t LEFT JOIN linked ON linked.conv_id = t.conv_id AND linked.turn = t.turn),
w AS (SELECT conv_id, turn, [turn] AS path FROM par WHERE parent_turn IS NULL UNION ALL SELECT c.conv_id, c.turn, list_append(path, c.turn) FROM w JOIN par c ON c.conv_id = w.conv_id AND c.parent_turn = w.turn),
o AS (SELECT w.conv_id, w.turn, parent_turn, CASE WHEN bool_or(parent_turn IS DISTINCT FROM prev) OVER (PARTITION BY w.conv_id) THEN min(w.turn) OVER (PARTITION BY w.conv_id) + row_number() OVER (PARTITION BY w.conv_id ORDER BY path) - 1 ELSE w.turn END AS place
  FROM w JOIN par ON par.conv_id = w.conv_id AND par.turn = w.turn),
n AS (SELECT conv_id, turn, count(DISTINCT (level, text)) AS n FROM p GROUP BY 1, 2)
SELECT m.conv_id, m.turn, role, coalesce(n.n, 0)::BIGINT AS n_quotes, parent_turn, place, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || body || chr(10) || '<|end|>' AS chat
FROM m JOIN own ON own.rid = m.rid LEFT JOIN o ON o.conv_id = m.conv_id AND o.turn = m.turn LEFT JOIN n ON n.conv_id = m.conv_id AND n.turn = m.turn
"""


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_versions(table(spark, sf_dir, "documents"))


SHARDS = [f"shard-{i:02d}" for i in range(32)]


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS).select("doc_id", "slot", "shard")


OP7_SQL = rf"""
WITH d AS (SELECT doc_id, ('0x' || substr(sha256(coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, ''))), 1, 15))::BIGINT % {sharding.SLOTS} AS slot FROM documents),
t AS (SELECT {sharding.fill(SHARDS)} AS t)
SELECT doc_id, slot, 'shard-' || lpad(t[slot + 1]::VARCHAR, 2, '0') AS shard FROM d, t
"""


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archives = warc.write_archives(pages, Scratch(spark, "warc").path("archives"))
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?[0-9]+)$", 1).try_cast("long")
    out = warc.read_archives(archives, payload=False)
    return out.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "valid")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h))::BIGINT AS n, sha1(h) AS s FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS top FROM q)
SELECT page_id, n AS payload_bytes, s AS payload_digest, CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to, true AS valid
FROM r
"""


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
m AS MATERIALIZED (SELECT part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)::INT AS mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
n AS MATERIALIZED (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY 1, 2),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[:step - 1]), 0)::INT AS gone FROM (SELECT filter_order, bits, unnest(range(1, 6))::INT AS step FROM o)),
r AS MATERIALIZED (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE mask & (own | gone) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE mask & own > 0 AND mask & gone = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE mask & own > 0 AND mask & gone > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & own > 0 AND mask & gone = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE mask & own > 0 AND mask & gone = 0), 0)::BIGINT AS toxic_lost
  FROM n, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS d FROM (SELECT rid, lang, source, unnest(w) AS term FROM d) GROUP BY 1, 2, 3),
k AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM c GROUP BY 1, 2 HAVING sum(d) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY 1),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
own AS (SELECT c.lang, c.source, sum(c.n) AS n FROM c JOIN k ON k.lang = c.lang AND k.term = c.term GROUP BY 1, 2),
dense AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(own.n, 0) + v.v))::BIGINT AS p, (1 + (1000000000::HUGEINT * (k.n + 1)) // (v.n + v.v))::BIGINT AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN own ON own.lang = g.lang AND own.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM dense a JOIN dense b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM dense WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM terms) WHERE rank <= 200
"""


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_winnowing": op2_winnowing,
    "op3_language": op3_language,
    "op4_mixing": op4_mixing,
    "op5_secrets": op5_secrets,
    "op6_quotations": op6_quotations,
    "op7_sharding": op7_sharding,
    "op8_fingerprints": op8_fingerprints,
    "op9_toxicity": op9_toxicity,
    "op10_warc": op10_warc,
    "op11_filter_audit": op11_filter_audit,
    "op12_divergence": op12_divergence,
    "op13_neighbours": op13_neighbours,
}
ORACLES: dict[str, str] = {
    "op1_near_dedup": OP1_SQL,
    "op2_winnowing": OP2_SQL,
    "op4_mixing": OP4_SQL,
    "op6_quotations": OP6_SQL,
    "op7_sharding": OP7_SQL,
    "op10_warc": OP10_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_divergence": OP12_SQL,
}
