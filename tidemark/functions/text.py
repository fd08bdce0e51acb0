"""Text and URL columns: pages, links, terms, commands, keys (inventory D, F1, P8, Q1, Q4, N1 to N4)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- pages and links -------------------------------------------------------------

# The steps from HTML to text, in order.
HTML_STEPS = (
    (r"(?i)<script\b[^>]*>[\s\S]*?</script>", " "),
    (r"(?i)<style\b[^>]*>[\s\S]*?</style>", " "),
    (r"(?i)<(?:br|/p|/div|/li|/tr|/h[1-6])\s*>", "\n"),
    (r"<[^>]+>", " "),
    (r"(?i)&nbsp;", " "),
    (r"(?i)&amp;", "&"),
    (r"(?i)&lt;", "<"),
    (r"(?i)&gt;", ">"),
    (r"(?i)&quot;", '"'),
    (r"(?i)&#39;", "'"),
    (r"\r", ""),
    (r"[ \t]+\n", "\n"),
    (r"\n[ \t]+", "\n"),
    (r"[ \t]{2,}", " "),
    (r"\n{4,}", "\n\n\n"),
)
#: White space that trimming removes: more than Spark's trim, which knows the space only.
SPACE = r"[\s ﻿]+"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}|{SPACE}\z", "")


def html_to_text(html: Column) -> Column:
    """D1."""
    for pattern, to in HTML_STEPS:
        html = F.regexp_replace(html, pattern, to)
    return trimmed(html)


def links(html: Column) -> Column:
    """Distinct link targets in the order first seen; none with a fragment sign."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*\bhref\s*=\s*["']([^"'#]+)["']"""), 1))


def canonical_url(target: Column, base: Column) -> Column:
    """D3: the target resolved against the base; null unless https. Without fragment, tracking
    parameters and doubled slashes; the host in lower case; an empty path is ``/``."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*/|/)?", 1)
    full = (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), target))
        .when(target.startswith("/"), F.concat(root, target))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), target))
    )
    full = F.regexp_replace(full, "#.*$", "")
    host = F.lower(F.regexp_extract(full, r"^(?i)https://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(full, r"^(?i)https://[^/?#]*([^?#]*)", 1), "/{2,}", "/")
    pairs = F.filter(F.split(F.regexp_extract(full, r"\?([^#]*)$", 1), "&"), lambda p: (p != "") & ~p.rlike("(?i)^(?:utm_[^=]*|ref|source|campaign)(?:=|$)"))
    query = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    return F.when(full.rlike(r"^(?i)https://[^/?#]"), F.concat(F.lit("https://"), host, F.when(path == "", "/").otherwise(path), query))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def same_site(host: Column, domain: Column) -> Column:
    """The domain or a name under it."""
    return (F.lower(host) == domain) | F.endswith(F.lower(host), F.concat(F.lit("."), domain))


# Document types by path, first match.
DOCUMENT_TYPES = (
    (r"(?:command|cli)[_-]?(?:reference|ref|guide)", "command_reference"),
    (r"(?:release|rn)[_-]?(?:note|notes)?", "release_notes"),
    (r"(?:security|advisory|psirt|cve)", "security_advisory"),
    (r"(?:upgrade|install)", "upgrade_guide"),
    (r"(?:configuration|config)[_-]?(?:guide|reference)?", "configuration_guide"),
)


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The label of the first rule whose pattern occurs."""
    out = None
    for pattern, label in rules:
        out = F.when(text.rlike(pattern), label) if out is None else out.when(text.rlike(pattern), label)
    return out.otherwise(default)


def document_type(url: Column) -> Column:
    """D5."""
    return first_match(F.lower(path_of(url)), DOCUMENT_TYPES, "official_vendor_document")


def title_from_url(url: Column) -> Column:
    """The last path segment, decoded where that works, at most 500 characters."""
    last = F.element_at(F.filter(F.split(path_of(url), "/"), lambda s: s != ""), -1)
    # decoding reads "+" as a space, which a path doesn't mean
    return F.substring(F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last, F.lit("Official vendor document")), 1, 500)


def content_hash(text: Column) -> Column:
    """D12."""
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def is_heading(block: Column) -> Column:
    """One line of at most 180 characters, in capitals or numbered."""
    return (F.length(block) <= 180) & ~F.contains(block, F.lit("\n")) & (block.rlike(r"^[A-Z0-9][A-Z0-9 /:_.()-]{5,}$") | block.rlike(r"^[0-9]+(?:\.[0-9]+)*\s+\S"))


def is_contents_page(page: Column) -> Column:
    """Looks like a table of contents."""
    lines = F.filter(F.transform(F.split(page, "\n"), trimmed), lambda x: x != "")
    dotted = F.size(F.filter(lines, lambda x: x.rlike(r"(?i)\.{5,}\s*(?:[0-9]+|[ivxlcdm]+)\s*$")))
    headed = F.exists(F.slice(lines, 1, 20), lambda x: x.rlike(r"(?i)^(?:table of )?contents?(?:\s|$)"))
    return (F.size(lines) >= 4) & ((headed & (dotted >= 3)) | ((dotted >= 6) & (dotted * 8 >= F.size(lines))))


# --- terms -----------------------------------------------------------------------

# Words that don't tell a request apart.
IGNORED_TERMS = [
    "about", "after", "before", "catalyst", "check", "cisco", "command", "commands", "configure", "configuration", "current", "device", "diagnose",
    "diagnosis", "error", "errors", "existing", "failure", "failures", "for", "from", "guide", "help", "how", "interface", "into", "ios", "iosxe",
    "issue", "network", "operating", "procedure", "running", "show", "switch", "system", "that", "the", "then", "this", "through", "troubleshoot",
    "using", "vendor", "verify", "verification", "version", "what", "when", "with", "xe", "your",
]
# Words of a question that aren't searched.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "catalyst", "check", "cisco", "cli", "command", "commands", "could", "did", "do", "does",
    "exact", "for", "from", "give", "how", "i", "if", "in", "inspect", "increasing", "ios", "is", "it", "may", "mode", "must", "my", "need", "next",
    "of", "on", "or", "our", "please", "provide", "require", "required", "requires", "run", "safe", "should", "state", "tell", "that", "the",
    "their", "then", "this", "to", "use", "using", "want", "what", "when", "where", "which", "who", "why", "will", "with", "workflow", "would", "xe",
    "you", "your",
]
# Aliases of question words; an empty one removes the word.
ALIASES = {"9300": "", "c9300": "", "errors": "error", "interfaces": "interface", "port": "interface", "ports": "interface"}
# Words without meaning of their own for the relevance floor.
GENERIC_TERMS = [
    "add", "change", "configure", "configuration", "create", "delete", "disable", "enable", "manage", "remove", "running", "set", "setup", "show",
]


def demand_terms(question: Column) -> Column:
    """At most twelve distinct telling terms, in order."""
    found = F.regexp_extract_all(F.lower(question), F.lit("([a-z][a-z0-9]*(?:[-_/][a-z0-9]+)*)"), 1)
    useful = F.filter(found, lambda x: F.length(x).between(3, 64) & ~x.isin(IGNORED_TERMS) & ~x.rlike("^[a-z]{1,2}[0-9]{2,5}[a-z0-9-]*$"))
    return F.slice(F.array_distinct(useful), 1, 12)


def matched_terms(text: Column, terms: Column) -> Column:
    """The terms that stand in the text as whole words. Each character that is no letter or digit gets a mark on both sides, in text
    and term, so that a whole word is one between marks; a text is marked once for all of its terms."""
    mark = "\x01"
    marked = lambda x: F.concat(F.lit(mark), F.regexp_replace(x, "([^a-z0-9])", f"{mark}$1{mark}"), F.lit(mark))
    return once(marked(F.lower(text)), lambda whole: F.filter(terms, lambda x: F.contains(whole, marked(x))))


def relevant(text: Column, terms: Column) -> Column:
    """Any term matches; without terms everything does."""
    return (F.size(terms) == 0) | (F.size(matched_terms(text, terms)) > 0)


def question_tokens(question: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """at most eight search tokens, in order."""
    plain = F.regexp_replace(F.regexp_replace(question, "<[^>]{1,80}>", " "), r"[<>{}\[\]|]", " ")
    words = F.regexp_extract_all(F.lower(plain), F.lit("([a-z0-9]+)"), 1)
    table = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv)) if aliases else None
    mapped = F.transform(words, lambda w: F.coalesce(table[w], w)) if aliases else words
    kept = F.filter(F.array_distinct(mapped), lambda w: (F.length(w) >= 2) & (~w.rlike("^[0-9]+$") | (F.length(w) >= 3)) & ~w.isin(STOP_WORDS))
    return F.slice(F.when(F.size(kept) > 0, kept).otherwise(words), 1, 8)


def rewritten_question(question: Column) -> Column:
    """a question on port errors asks for counters."""
    ports = question.rlike(r"(?i)\berrors?\b") & question.rlike(r"(?i)\b(?:ports?|interfaces?)\b")
    first = F.regexp_replace(question, r"(?is)\A(.*?)\berrors?\b", "$1display interface counters errors")
    return F.when(ports, first).otherwise(question)


def trigrams(text: Column) -> Column:
    """distinct trigrams of the lower-case words, each with two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of)))


def trigram_codes(text: Column) -> Column:
    """the distinct trigrams as numbers, one each, as they are of blanks, a to z and digits only."""
    return F.transform(trigrams(text), lambda g: F.ascii(g) * 16384 + F.ascii(F.substring(g, 2, 1)) * 128 + F.ascii(F.substring(g, 3, 1)))


def shared_trigrams(a: Column, b: Column) -> Column:
    """common over all of two arrays of distinct trigrams; 0 without any."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0))


def similarity(left: Column, right: Column) -> Column:
    """common over all trigrams; 0 without any."""
    return shared_trigrams(trigrams(left), trigrams(right))


# --- commands and risk --------------------------------------------------------------

# Words that begin a command line.
COMMAND_START = (
    r"(?i)^(?:no\s+)?(?:show|display|ping|traceroute|traceroute6|verify|dir|more|less|terminal|configure|interface|router|switchport|spanning-tree|ip|ipv6|aaa|bfd|bgp|ospf|isis|eigrp|"
    r"route-map|policy-map|class-map|logging|snmp-server|crypto|username|monitor|copy|clear|debug|reload|install|boot|erase|delete|format)\b"
)
# Lines that only read.
READ_ONLY = (
    r"(?i)^(?:show|display|ping|traceroute|tracert|terminal length|dir|more|verify)\b",
    r"(?i)^(?:onie-sysinfo|onie-support|uname|uptime)(?:\s|$)",
    r"(?i)^clagctl(?:\s+(?:status|show)(?:\s|$)|\s*$)",
    r"(?i)^nv\s+show\b",
    r"(?i)^networkctl(?:\s+(?:list|status|lldp|label)(?:\s|$)|\s*$)",
    r"(?i)^swconfig\s+dev(?:\s+\S+)?\s+show(?:\s|$)",
    r"(?i)^ip(?:\s+-\S+)*\s+(?:link|address|addr|route|neighbor|neigh|rule)(?:\s+(?:show|list)(?:\s|$)|\s*$)",
)
ETHTOOL_READS = r"(?i)^ethtool(?:\s+(?:-[aAdgiklmnpST]|--show-[a-z-]+))*\s+\S+(?:\s|$)"
ETHTOOL_WRITES = r"(?i)\s(?:-s|--change|--set-[a-z-]+)\b"
# Risk patterns over the whole text, first match.
RISK_PATTERNS = (
    (r"(?i)\b(?:factory[- ]reset|write erase|erase\s+startup-config)\b", "factory_reset"),
    (r"(?i)\bformat\s+(?:flash|bootflash|nvram)\b", "storage_wipe"),
    (r"(?i)\b(?:delete|erase)\s+(?:flash|bootflash|nvram):", "data_loss"),
    (r"(?i)\b(?:crypto key zeroize|no\s+aaa\s+new-model)\b", "credential_sensitive"),
    (r"(?i)\bboot system\b", "boot_change"),
    (r"(?i)\binstall\s+(?:add|activate|commit|remove)\b", "firmware_change"),
    (r"(?i)\breload\b", "service_disruptive"),
    (r"(?im)^(?:configure terminal|interface\b|router\b|ip route\b|access-list\b|vlan\b|spanning-tree\b|no\b|shutdown\b|snmp-server\b|ntp\b|logging\b)", "changes_config"),
)
# Priority of risk levels; equal ones don't escalate each other.
RISK_PRIORITY = {
    "safe_read_only": 0,
    "changes_config": 2,
    "unknown": 4,
    "credential_sensitive": 5,
    "service_disruptive": 6,
    "firmware_change": 6,
    "data_loss": 7,
    "boot_change": 7,
    "storage_wipe": 8,
    "factory_reset": 9,
}


def command_lines(content: Column, limit: int = 10) -> Column:
    """Distinct command lines of a reference text, in order."""
    def clean(x: Column) -> Column:
        return trimmed(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^[•*]\s*", ""), r"^[0-9]+[.)]\s+", ""), r"\s+", " "))

    def kept(x: Column) -> Column:
        return F.length(x).between(3, 300) & x.rlike(COMMAND_START) & ~x.rlike("[.!?]$") & ~x.rlike(r"(?i)\b(?:example|purpose|description|syntax)\s*:")

    def add(found: Column, x: Column) -> Column:
        new = (F.size(found) < limit) & kept(x) & ~F.exists(found, lambda y: y["low"] == F.lower(x))
        return F.when(new, F.concat(found, F.array(F.struct(x.alias("line"), F.lower(x).alias("low"))))).otherwise(found)

    none = F.expr("cast(array() as array<struct<line: string, low: string>>)")
    lines = F.transform(F.split(content, "\n"), clean)
    return F.aggregate(lines, none, add, lambda found: F.transform(found, lambda y: y["line"]))


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` the value, which is computed once however often it uses it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def reads_only(line: Column) -> Column:
    out = line.rlike(ETHTOOL_READS) & ~line.rlike(ETHTOOL_WRITES)
    for p in READ_ONLY:
        out = out | line.rlike(p)
    return out


def risk(lines: Column) -> Column:
    """Q4: the risk level of an array of command lines; none are safe."""
    own = F.flatten(F.transform(lines, lambda x: F.split(x, r"\r?\n")))
    own = F.filter(F.transform(own, lambda x: trimmed(F.regexp_replace(x, r"^[+-]\s?", ""))), lambda x: x != "")
    safe = lambda own: (F.size(lines) == 0) | ((F.size(own) > 0) & F.forall(own, reads_only))
    worst = lambda own: once(F.array_join(own, "\n"), lambda text: first_match(text, RISK_PATTERNS, "unknown"))
    return once(own, lambda own: F.when(safe(own), "safe_read_only").otherwise(worst(own)))


def escalated(declared: Column, found: Column) -> Column:
    """Q5: the found level where its priority is higher than the declared one's."""
    table = F.create_map(*(F.lit(x) for kv in RISK_PRIORITY.items() for x in kv))
    return F.when(table[found] > table[declared], found).otherwise(declared)


def stable_key(value: Column) -> Column:
    """Q1: the normalised key, or the value itself where that is no key."""
    x = F.regexp_replace(F.regexp_replace(F.lower(trimmed(value)), "[^a-z0-9._-]+", "-"), "^[^a-z0-9]+", "")
    x = F.regexp_replace(F.regexp_replace(x, "[._-]{2,}", "-"), r"[._-]+\z", "")
    x = F.regexp_replace(F.substring(x, 1, 160), r"[._-]+\z", "")
    return F.when(x.rlike(r"^[a-z0-9](?:[a-z0-9._-]*[a-z0-9])?\z") & (F.length(x) >= 3), x).otherwise(value)


# --- redaction ----------------------------------------------------------------------

# Redaction steps in order (type, pattern, replacement); the strict profile adds the later ones.
SECRET_STEPS = (
    ("private_key", r"(?i)-----BEGIN [^-]*PRIVATE KEY-----[\s\S]*?-----END [^-]*PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
    ("secret", r"(?i)\b(Bearer|Basic)\s+[A-Za-z0-9._~+/=-]{12,}", "$1 [REDACTED_SECRET]"),
    ("secret", r"(?i)(\b(?:password|secret|community|key-string|pre-shared-key|auth-password|tacacs-server key|radius-server key)\b(?:\s+[0-9]+\s+|\s+))([^\s,;]+)", "$1[REDACTED_SECRET]"),
    ("serial", r"(?im)^(\s*(?:system serial number|processor board id|chassis serial number|serial number)\s*:?\s*)(\S+)", "$1[REDACTED_SERIAL]"),
)
STRICT_STEPS = (
    ("username", r"(?im)^(\s*username\s+)(\S+)", "$1[REDACTED_USERNAME]"),
    ("hostname", r"(?im)^(\s*hostname\s+)(\S+)", "$1[REDACTED_HOSTNAME]"),
    ("mac_address", r"(?i)\b(?:[0-9a-f]{2}[:-]){5}[0-9a-f]{2}\b|\b[0-9a-f]{4}\.[0-9a-f]{4}\.[0-9a-f]{4}\b", "[REDACTED_MAC]"),
    ("ip_address", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?:/[0-9]{1,2})?\b", "[REDACTED_IP]"),
    # IPv6: eight groups, or fewer around one "::"; an IPv4 tail is redacted by the step before
    (
        "ip_address",
        r"(?i)(?<![0-9a-f:.])(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?=(?:[0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4}(?![0-9a-f:.]))(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6})?::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6})?)(?![0-9a-f:.])(?:/[0-9]{1,3})?",
        "[REDACTED_IP]",
    ),
)


def redacted(text: Column, strict: bool) -> tuple[Column, dict[str, Column]]:
    """The text without secrets (strict: nor names and addresses), and counts by type. Counts are
    taken from the text as each step finds it."""
    text = F.replace(text, F.lit("\x00"), F.lit(""))
    counts: dict[str, Column] = {}
    for kind, pattern, to in (*SECRET_STEPS, *(STRICT_STEPS if strict else ())):
        n, clean = F.regexp_count(text, F.lit(pattern)), F.regexp_replace(text, pattern, to)
        if "::" in pattern:  # the costly one: no IPv6 address is without a colon
            colon = F.contains(text, F.lit(":"))
            n, clean = F.when(colon, n).otherwise(F.lit(0)), F.when(colon, clean).otherwise(text)
        counts[kind] = counts[kind] + n if kind in counts else n
        text = clean
    return text, counts


# Kinds of device text, first match.
SNAPSHOT_TYPES = (
    (r"(?i)Cisco IOS|Junos:|Software image version:|show version", "show_version"),
    (r"(?i)Device ID:|Local Intf:|System Name:|traceroute to|Routing entry for", "topology"),
    (r"(?im)^%[A-Z0-9_-]+-[0-9]+-|Traceback|syslog", "log"),
    (r"(?im)^(?:hostname|interface|router|ip route|vlan|line |aaa )", "config"),
)


def snapshot_type(text: Column) -> Column:
    """N4."""
    return first_match(text, SNAPSHOT_TYPES, "other")


def safe_url(url: Column) -> Column:
    """Https without credentials, port 443, no local host name, no blocked address literal."""
    authority = F.regexp_extract(url, r"^(?i)https://([^/?#]*)", 1)
    port = F.regexp_extract(authority, r":([0-9]*)$", 1)
    host = F.lower(F.regexp_replace(authority, r":[0-9]*$", ""))
    octet = lambda i: F.regexp_extract(host, r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$", i).try_cast("int")
    a, b = octet(1), octet(2)
    v4 = a.isin(0, 10, 127) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & b.isin(0, 168)) | ((a == 198) & b.isin(18, 19)) | (a >= 224)
    # an address in brackets that maps an IPv4 one is taken as blocked
    v6 = host.rlike(r"^\[(?:::|f[cdef]|64:ff9b:|100:|2001:0:|2001:2:|2001:db8:)")
    local = (host == "localhost") | host.rlike(r"\.(?:localhost|local|internal)$") | (host == "")
    good = url.rlike(r"^(?i)https://") & ~F.contains(authority, F.lit("@")) & port.isin("", "443") & ~local & ~F.coalesce(v4, F.lit(False)) & ~v6
    return F.coalesce(good, F.lit(False))
