"""Column functions and operators against expected values."""

import decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import versions as V
from tidemark.operators import documents as D
from tidemark.operators import network as N
from tidemark.operators import quality as Q
from tidemark.operators import relational as R
from tidemark.operators import releases as L
from tidemark.operators import search as S
from tidemark.streaming import jobs as J


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("a", "b", "sign"), [("17.9.4a", "17.9.4", 1), ("16.12.10", "17.3.1", -1), ("17.9", "17.9.0", 0), (None, "1", None)])
def test_version_order(spark, a, b, sign):
    assert value(spark, V.compare(V.parts(F.lit(a)), V.parts(F.lit(b)))) == sign


def test_version_ranges_and_branches(spark):
    low, high = V.parts(F.lit("16.6")), V.parts(F.lit("17.12"))
    assert value(spark, V.applicable(V.parts(F.lit("17.9.4")), low, high))
    assert not value(spark, V.applicable(V.parts(F.lit("16.3.1")), low, high))
    assert value(spark, V.branch(F.lit("9.3.8"), F.lit("major_minor"))) == "9.3"
    assert value(spark, V.branch(F.lit("202311"), F.lit("calendar"))) == "2023.11"
    assert value(spark, V.branch(F.lit("9.3.8"), F.lit("vendor"))) is None
    exact = V.parts(F.lit("9.3.8"))
    got = lambda v: value(spark, V.match(F.lit(v), exact, exact, F.lit("exact"), F.lit("9.3"), F.lit("major_minor")))
    assert [got(x) for x in ("9.3.8", "9.3.9", "10.1.1", None)] == ["exact", "same_branch_fallback", None, "branch"]
    pairs = [("os_family", "unbounded"), ("model", "same_branch_fallback"), ("model", "exact")]
    assert [value(spark, V.assurance(F.lit(a), F.lit(b))) for a, b in pairs] == ["generic", "best_effort", "exact"]


@pytest.mark.parametrize(
    ("line", "level"),
    [("ip link show", "safe_read_only"), ("ip addr", "safe_read_only"), ("nv show interface status", "safe_read_only"), ("ip link set eth0 down", "unknown"), ("networkctl reload", "service_disruptive"), ("write erase", "factory_reset"), ("interface Gi1/0/1", "changes_config")],
)
def test_risk(spark, line, level):
    assert value(spark, T.risk(F.array(F.lit(line)))) == level


def test_risk_edges(spark):
    none = F.expr("cast(array() as array<string>)")
    assert value(spark, T.risk(none)) == "safe_read_only"
    assert value(spark, T.risk(F.array(F.lit("show version\nreload")))) == "service_disruptive"
    assert value(spark, T.escalated(F.lit("firmware_change"), F.lit("service_disruptive"))) == "firmware_change"
    assert value(spark, T.escalated(F.lit("unknown"), F.lit("data_loss"))) == "data_loss"


def test_html_and_urls(spark):
    page = "<html><script>var x = '<p>';</script><p>A&amp;B</p><div>two  words</div></html>"
    assert value(spark, T.html_to_text(F.lit(page))) == "A&B\ntwo words"
    base = "https://Docs.Example.com/a/b.html?x=1"
    got = lambda v: value(spark, T.canonical_url(F.lit(v), F.lit(base)))
    assert got("c?utm_source=q&k=2#f") == "https://docs.example.com/a/c?k=2"
    assert got("/x//y?ref=1") == "https://docs.example.com/x/y"
    assert got("http://example.com/") is None and got("mailto:a@b.c") is None
    assert got("//other.org") == "https://other.org/"
    assert value(spark, T.title_from_url(F.lit("https://h/a/My%20Guide"))) == "My Guide"
    safe = lambda v: value(spark, T.safe_url(F.lit(v)))
    assert safe("https://example.com/x") and safe("https://example.com:443/")
    assert not any(map(safe, ["http://example.com", "https://u:p@example.com", "https://example.com:8443", "https://localhost/", "https://10.0.0.1/", "https://169.254.1.1/", "https://[::1]/", None]))


def test_terms(spark):
    terms = value(spark, T.demand_terms(F.lit("How to verify Cisco MACsec MKA rekey on C9300-48P")))
    assert {"macsec", "mka", "rekey"} <= set(terms) and not {"cisco", "verify", "c9300-48p"} & set(terms)
    assert not value(spark, T.relevant(F.lit("a remacsec-test"), F.array(F.lit("macsec"))))
    assert value(spark, T.relevant(F.lit("MACSEC."), F.array(F.lit("macsec"))))
    tokens = value(spark, T.question_tokens(F.lit("Demo block | !secret <-> reference length")))
    assert tokens == ["demo", "block", "secret", "reference", "length"]
    question = T.rewritten_question(F.lit("How do I check port errors?"))
    assert value(spark, T.question_tokens(question)) == ["interface", "display", "counters", "error"]


def test_redaction(spark):
    banner = "hostname core-1\nusername bob secret 5 abc123\nSystem serial number : FOC1234\nip 10.1.2.3 and fe80::1 and 00:11:22:33:44:55\n"
    clean, counts = T.redacted(F.lit(banner), True)
    text = value(spark, clean)
    assert not any(x in text for x in ("core-1", "bob", "abc123", "FOC1234", "10.1.2.3", "fe80::1", "00:11:22"))
    assert value(spark, counts["ip_address"]) == 2
    again, _ = T.redacted(F.lit(text), True)
    assert value(spark, again) == text
    assert "core-1" in value(spark, T.redacted(F.lit(banner), False)[0])


def test_fragments(spark):
    sections = "\n\n".join(f"SECTION NUMBER {i}\n\n{'word ' * 1500}\n\nshow item {i}" for i in range(20))
    rows = D.fragments(spark.createDataFrame([(1, sections)], "id long, text string"), "id").collect()
    assert all(len(r["content"].encode()) <= D.MAX_BYTES for r in rows)
    assert all(any(f"show item {i}" in r["content"] for r in rows) for i in range(20))
    assert sorted(r["ordinal"] for r in rows) == list(range(len(rows)))
    assert len({r["content_hash"] for r in rows}) == len(rows)


def test_long_blocks_and_repeats(spark):
    emoji = "😀 text " * 3000 + "\nlast line"
    rows = D.fragments(spark.createDataFrame([(1, emoji), (2, "1 ONE\n\nsame\n\n2 TWO\n\nsame\n\n3 THREE\n\nother"), (3, None), (4, "")], "id long, text string"), "id").collect()
    assert all(len(r["content"].encode()) <= D.MAX_BYTES for r in rows)
    assert any("last line" in r["content"] for r in rows if r["id"] == 1)
    assert [(r["ordinal"], r["content"]) for r in rows if r["id"] == 2] == [(0, "same"), (1, "other")]
    assert not [r for r in rows if r["id"] in (3, 4)]


def test_contents_pages(spark):
    toc = "Contents\n" + "\n".join(f"Chapter {i} ........ {i}" for i in range(8))
    got = value(spark, D.without_contents_pages(F.lit("Cover\f" + toc + "\fshow version")))
    assert "....." not in got and "show version" in got
    assert "....." in value(spark, D.without_contents_pages(F.lit(toc + "\f" + toc)))


def test_commands(spark):
    text = "• show version\n1. show ip route\nShow the version.\nPurpose: show x\nshow version\nno text"
    assert value(spark, T.command_lines(F.lit(text))) == ["show version", "show ip route"]


@pytest.mark.parametrize(("a", "b"), [("1.10", "1.9"), ("-2", "-10"), ("0.000", "-0"), ("123456789012345678901234567890123456789012", "123456789012345678901234567890123456789011.9"), ("-0.5", "0.4"), ("7", "7.000")])
def test_exact_decimals(spark, a, b):
    want = (decimal.Decimal(a) > decimal.Decimal(b)) - (decimal.Decimal(a) < decimal.Decimal(b))
    assert value(spark, Q.compare_decimals(F.lit(a), F.lit(b))) == want
    assert value(spark, Q.compare_decimals(F.lit(b), F.lit(a))) == -want
    assert value(spark, Q.compare_decimals(F.lit("1e5"), F.lit(b))) is None


def test_gate_thresholds(spark):
    rows = spark.createDataFrame([(True, 0.95, 1, "data_loss"), (True, 0.94, 0, "safe_read_only"), (False, 0.9, 0, "safe_read_only")], "dangerous boolean, confidence double, rollback_steps int, risk_level string")
    assert [len(r["i"]) for r in rows.select(Q.gate().alias("i")).collect()] == [0, 3, 0]


def test_json_redaction(spark):
    rows = spark.createDataFrame([('{"a":{"token":"x","b":[1,"y"]}}',), ("{broken",), (None,)], "p string")
    assert [r["p"] for r in Q.redact_json(rows, "p", ["token"]).collect()] == ['{"a":{"b":[1,"y"],"token":"[REDACTED]"}}', '"[REDACTED]"', None]
    assert Q.redact_json(rows, "p", [], mask_all=True).first()["p"] == '{"a":{"b":["[MASKED]","[MASKED]"],"token":"[MASKED]"}}'


def test_topology(spark):
    cdp = "Device ID: core.example.com\nIP address: 10.0.0.1\nPlatform: x,\nInterface: Gi1/0/1,  Port ID (outgoing port): Gi0/2\nDevice ID: SW1.local\n"
    snaps = spark.createDataFrame([("1", "sw1", cdp)], "snapshot_id string, device_hint string, content string")
    assert [(r["target"], r["local_interface"], r["remote_interface"]) for r in N.neighbour_edges(snaps).where("protocol = 'cdp'").collect()] == [("core.example.com", "Gi1/0/1", "Gi0/2")]
    trace = spark.createDataFrame([("1", "src", "traceroute to x\n 1  a (10.0.0.1) 1 ms\n 2  * * *\n 3  b 2 ms")], "snapshot_id string, device_hint string, content string")
    hops = N.trace_hops(trace, "snapshot_id").orderBy("place").collect()
    assert [(r["source"], r["target"]) for r in hops] == [("src", "a"), ("a", "Unanswered hop 2"), ("Unanswered hop 2", "b")]
    status = N.path_status(N.trace_hops(trace, "snapshot_id"), "snapshot_id").first()
    assert not status["complete"] and status["fault_domain"] == "a"
    route = spark.createDataFrame([("r", "Routing entry for 10.1.0.0/16\n  * directly connected, via Vlan1"), ("q", "Routing entry for 10.2.0.0/16\n via 10.0.0.9")], "device_hint string, content string")
    assert N.route_edges(route).count() == 3


def test_change_verification(spark):
    changes = spark.createDataFrame([(1, ["interface Gi1", "shutdown"], "up", "administratively down"), (2, ["description x"], "same", "same"), (3, ["shutdown"], "x", ""), (4, ["show run"], "a", "a")], "id int, commands array<string>, before string, after string")
    reviewed = N.change_review(changes, "id").join(changes, "id")
    got = {r["id"]: r["result"] for r in N.change_verification(reviewed, "rules", "before", "after").collect()}
    assert got == {1: "passed", 2: "failed", 3: "partial", 4: "passed"}


def test_fingerprint(spark):
    f = value(spark, N.fingerprint(F.lit("Cisco IOS XE Software, Version 17.09.04a\ncisco C9300-48P (X86) processor")))
    assert (f["vendor"], f["model"], f["version"]) == ("Cisco", "C9300-48P", "17.09.04a")
    assert value(spark, N.fingerprint(F.lit("nothing"))) is None
    i = value(spark, N.system_intent(F.lit("ONIE Rescue")))
    assert (i["family"], i["mode"]) == ("ONIE", "rescue")


def test_decomposition(spark):
    q = "reboot the box, set a static IP, check ARP, RX errors, and use TFTP"
    assert value(spark, S.capabilities(F.lit(q))) == ["system-reboot", "ip-configuration", "arp-diagnostics", "interface-counters", "tftp-transfer"]
    assert value(spark, S.supports(F.lit("ip address add 10.0.0.1"), F.lit("ip-configuration")))
    assert not value(spark, S.supports(F.lit("logging host"), F.lit("ip-configuration")))


def test_release_replay(spark):
    rel = spark.createDataFrame([("1", None, "snapshot"), ("2", "1", "delta"), ("3", "2", "delta")], "release_id string, parent_release_id string, release_mode string")
    full = spark.createDataFrame([("1", "a", "a1"), ("1", "b", "b1")], "release_id string, item_id string, revision_id string")
    changes = spark.createDataFrame([("2", "a", "a2"), ("3", "b", None), ("3", "c", "c1")], "release_id string, item_id string, new_revision_id string")
    at = lambda r: {x["item_id"]: x["revision_id"] for x in L.state_at(rel, full, changes, r).collect()}
    assert at("1") == {"a": "a1", "b": "b1"}
    assert at("2") == {"a": "a2", "b": "b1"}
    assert at("3") == {"a": "a2", "c": "c1"}


def test_cooldown_and_percentiles(spark):
    assert [value(spark, J.cooldown(F.lit(n))) for n in (3, 4, 8, 100)] == [0, 30, 60, 300]
    rows = spark.createDataFrame([("a", float(i)) for i in range(1, 101)], "k string, v double")
    r = R.nearest_rank(rows, ["k"], "v", {"p50": 0.5, "p95": 0.95}).first()
    assert (r["p50"], r["p95"], r["max"], r["n"]) == (50.0, 95.0, 100.0, 100)


def test_density_prefers_close_terms(spark):
    texts = {1: "alpha beta", 2: "alpha x x x x x beta", 3: "alphabet soup betas", 4: "alpha alpha beta x alpha", 5: "alpha only"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    asked = S.questions(spark.createDataFrame([(7, "alpha beta"), (8, "beta")], "q long, text string"), "q", "text")
    search = S.Search(S.Index(docs, "doc_id", {"body": (F.col("text"), "B")}), asked)
    got = {(r["question_id"], r["doc_id"]): r["strict_density"] for r in search.cover_density(search.matches()).collect()}
    assert got[7, 1] > got[7, 3] > got[7, 2] > 0 and (7, 5) not in got and got[8, 3] > 0
    share = lambda total: total / (1 + total)
    assert abs(got[7, 1] - share(0.4)) < 1e-9 and abs(got[7, 2] - share(0.4 / 6)) < 1e-9  # five words between
    # covers "alpha beta" and "beta x alpha"
    assert abs(got[7, 4] - share(0.4 + 0.4 / 2)) < 1e-9


def test_relaxed_covers_need_three_of_the_tokens(spark):
    docs = spark.createDataFrame([(1, "one two x three"), (2, "one two")], "doc_id long, text string")
    asked = S.questions(spark.createDataFrame([(7, "one two three four")], "q long, text string"), "q", "text")
    search = S.Search(S.Index(docs, "doc_id", {"title": (F.col("text"), "A")}), asked)
    (r,) = search.cover_density(search.matches()).collect()
    assert (r["doc_id"], r["matched"], r["strict"], r["strict_density"]) == (1, 3, False, 0.0) and abs(r["relaxed_density"] - 0.5 / 1.5) < 1e-9


def test_answers_go_by_scope_then_version_then_rank(spark):
    rows = [("os_family", "exact", 0.9, 1), ("model", "unbounded", 0.1, 2), ("model", "exact", 0.1, 3), ("model", "exact", 0.2, 4)]
    df = spark.createDataFrame([(0, f"k{i}", *r) for i, r in enumerate(rows)], "question_id long, key string, scope string, version_match string, rank double, doc_id long")
    out = S.final_order(df, S.answer_order(F.col("scope"), F.col("version_match"), F.col("rank"), F.col("doc_id")), "key", 3).orderBy("place")
    assert [r["doc_id"] for r in out.collect()] == [4, 3, 2]
