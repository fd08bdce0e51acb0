"""Candidate rules, gates and decisions (inventory Q, X)."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T

# Confidence to publish (dangerous, other) and quality to verify.
DANGEROUS_CONFIDENCE, CONFIDENCE, QUALITY = 0.95, 0.90, 0.85
# Units by dimension.
UNITS = {
    "length": ["mm", "cm", "m", "in", "ft"],
    "temperature": ["degC", "K"],
    "pressure": ["Pa", "kPa", "MPa", "psi"],
    "force": ["N", "kN"],
    "mass": ["g", "kg"],
    "time": ["ms", "s"],
    "frequency": ["Hz", "rpm"],
    "ratio": ["percent", "unitless"],
}
# Evidence roles from the weakest.
ROLES = ["conflict", "corroborating", "primary"]


def issues(rules: Mapping[str, Column]) -> Column:
    """Q6, Q9, Q10, Q26: the codes whose condition holds, in the order given; a null condition doesn't."""
    return F.filter(F.array(*(F.when(cond, F.lit(code)) for code, cond in rules.items())), lambda x: x.isNotNull())


def optional_text(value: Column, limit: int = 120) -> Column:
    """Q2: trimmed, white space collapsed; null when empty or longer than the limit."""
    x = F.regexp_replace(T.trimmed(value), r"\s+", " ")
    return F.when(F.length(x).between(1, limit), x)


def bind_hashes(candidates: DataFrame, fragments: DataFrame) -> DataFrame:
    """Q3: the fragment table's hash in place of the candidate's own; both are kept where they differ."""
    trusted = fragments.select("fragment_id", F.col("content_hash").alias("_trusted"))
    out = candidates.join(trusted, "fragment_id", "left")
    return out.withColumn("rebound", ~F.col("content_hash").eqNullSafe(F.col("_trusted"))).withColumn("content_hash", F.col("_trusted")).drop("_trusted")


def network_rules(df: DataFrame) -> Column:
    """Q6."""
    return issues(
        {
            "NETWORK_CONTENT_REQUIRED": (F.coalesce("command", F.lit("")) == "") & (F.coalesce(F.size("procedure"), F.lit(0)) <= 0),
            "NETWORK_DANGEROUS_FALSE_SAFE": F.col("dangerous") & (F.col("risk_level") == "safe_read_only"),
            "NETWORK_MODEL_SCOPE_REQUIRES_PLATFORM": (F.col("applicability_scope") == "model") & (F.coalesce("platform_slug", F.lit("")) == ""),
            "NETWORK_ARCHITECTURE_SCOPE_REQUIRES_ARCHITECTURE": (F.col("applicability_scope") == "architecture") & (F.coalesce("architecture_slug", F.lit("")) == ""),
            "NETWORK_BRANCH_SCOPE_REQUIRES_BRANCH": (F.col("version_scope") == "branch") & (F.coalesce("version_branch", F.lit("")) == ""),
        }
    )


def compare_decimals(left: Column, right: Column) -> Column:
    """Q8: -1, 0 or 1 of two canonical decimal strings of any length, exactly; null unless both are canonical.

    Signs first, then the integer parts by length and digits, then the fractions padded with zeros.
    """
    def split(x: Column) -> tuple[Column, Column, Column]:
        whole = F.regexp_extract(x, r"^-?([0-9]+)", 1)
        fraction = F.regexp_replace(F.regexp_extract(x, r"\.([0-9]+)$", 1), "0+$", "")
        zero = (whole == "0") & (fraction == "")
        return F.when(zero, 0).when(x.startswith("-"), -1).otherwise(1), whole, fraction

    (sa, ia, fa), (sb, ib, fb) = split(left), split(right)
    size = lambda a, b: F.when(a < b, -1).when(a > b, 1).otherwise(0)
    # a fraction without its trailing zeros is in text order
    magnitude = F.when(F.length(ia) != F.length(ib), size(F.length(ia), F.length(ib))).when(ia != ib, size(ia, ib)).otherwise(size(fa, fb))
    canonical = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?$"
    return F.when(left.rlike(canonical) & right.rlike(canonical), F.when(sa != sb, size(sa, sb)).otherwise(magnitude * sa))


def measurement_rules() -> Column:
    """Q7: over (record_type, dimension, value, unit, tol_type, lower, upper, minus, plus, tol_unit, factor, input_unit, output_unit)."""
    table = F.create_map(*(x for k, v in UNITS.items() for x in (F.lit(k), F.array(*(F.lit(u) for u in v)))))
    fits = lambda unit: F.coalesce(F.array_contains(table[F.col("dimension")], F.col(unit)), F.lit(False))
    measured, converts = F.col("record_type").isin("measurement", "tolerance") & F.col("tol_type").isNotNull(), F.col("record_type") == "conversion"
    bounds, zero = measured & (F.col("tol_type") == "bounds"), F.lit("0")
    less = lambda a, b: compare_decimals(a, b) < 0
    return issues(
        {
            "UNIT_DIMENSION_MISMATCH": (measured & ~(fits("unit") & fits("tol_unit"))) | (converts & ~(fits("input_unit") & fits("output_unit"))),
            "TOLERANCE_UNIT_MISMATCH": measured & (F.col("unit") != F.col("tol_unit")),
            "NOMINAL_OUTSIDE_TOLERANCE": bounds & (less(F.col("value"), F.col("lower")) | less(F.col("upper"), F.col("value"))),
            "TOLERANCE_BOUNDS_REVERSED": bounds & less(F.col("upper"), F.col("lower")),
            "NEGATIVE_PLUS_MINUS": measured & (F.col("tol_type") != "bounds") & (less(F.col("minus"), zero) | less(F.col("plus"), zero)),
            "CONVERSION_FACTOR_NONPOSITIVE": converts & (compare_decimals(F.col("factor"), zero) <= 0),
        }
    )


def gate() -> Column:
    """Q9: what keeps a candidate (dangerous, confidence, rollback steps, risk_level) from publication."""
    need = F.when(F.col("dangerous"), DANGEROUS_CONFIDENCE).otherwise(CONFIDENCE)
    return issues(
        {
            "CONFIDENCE_BELOW_PUBLICATION_THRESHOLD": F.col("confidence") < need,
            "DANGEROUS_CANDIDATE_REQUIRES_ROLLBACK": F.col("dangerous") & (F.col("rollback_steps") == 0),
            "DANGEROUS_CANDIDATE_FALSE_SAFE": F.col("dangerous") & (F.col("risk_level") == "safe_read_only"),
        }
    )


def shape_issues(spec: Mapping[str, tuple[int, int, str | None]]) -> Column:
    """Q10: by column (shortest, longest, pattern); null values break the lower bound."""
    rules = {}
    for name, (low, high, pattern) in spec.items():
        ok = F.coalesce(F.length(name), F.lit(0)).between(low, high)
        rules[f"SHAPE_{name.upper()}"] = ~(ok & F.coalesce(F.col(name).rlike(pattern), F.lit(low == 0)) if pattern else ok)
    return issues(rules)


def catalogue_disposition(candidates: DataFrame, vendors: DataFrame, systems: DataFrame, platforms: DataFrame, items: DataFrame) -> DataFrame:
    """Q11: ``disposition``: what the catalogues say against a candidate, first objection; null: nothing."""
    out = candidates.join(vendors.select("vendor_slug", F.lit(True).alias("_v")).distinct(), "vendor_slug", "left")
    out = out.join(systems.select("vendor_slug", "os_slug", F.lit(True).alias("_o")).distinct(), ["vendor_slug", "os_slug"], "left")
    out = out.join(platforms.select("vendor_slug", "platform_slug", F.lit(True).alias("_p")).distinct(), ["vendor_slug", "platform_slug"], "left")
    out = out.join(items.groupBy("stable_key").agg(F.min("kind").alias("_kind")), "stable_key", "left")
    found = F.when(F.col("_v").isNull(), "deep_review:vendor").when(F.col("_o").isNull(), "deep_review:operating_system")
    found = found.when(F.col("platform_slug").isNotNull() & F.col("_p").isNull(), "deep_review:platform").when(F.col("_kind") != F.col("kind"), "conflict:kind")
    return out.withColumn("disposition", found).drop("_v", "_o", "_p", "_kind")


def final_decision(decision: Column, disposition: Column, confidence: Column, quality: Column, dangerous: Column) -> Column:
    """Q12: a catalogue objection to a verified candidate decides; else low scores send it to deep review."""
    low = (confidence < F.when(dangerous, DANGEROUS_CONFIDENCE).otherwise(CONFIDENCE)) | (quality < QUALITY)
    verified = decision == "verified"
    return F.when(verified, F.coalesce(F.substring_index(disposition, ":", 1), F.when(low, "deep_review"), decision)).otherwise(decision)


def omitted(leased: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """Q13: leased rows without a decision."""
    return leased.join(decided.select(key), key, "left_anti")


def patched(candidates: DataFrame, patches: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Q14: the patch's non-null fields over the candidate's, and null for the fields its ``clear`` list names."""
    p = patches.select(key, "clear", *(F.col(f).alias(f"_p_{f}") for f in fields))
    out = candidates.join(p, key, "left")
    for f in fields:
        out = out.withColumn(f, F.when(F.array_contains("clear", f), F.lit(None)).otherwise(F.coalesce(f"_p_{f}", f)))
    return out.drop("clear", *(f"_p_{f}" for f in fields))


def review_outcome(review_pass: Column) -> Column:
    """Q15: what stays unresolved goes on to deep review after the low pass, and is rejected after the medium."""
    return F.when(review_pass == "low", "deep_review").otherwise("rejected")


def unique_documents(provenance: DataFrame, keys: Sequence[str], role: str, order: str) -> DataFrame:
    """Q17: one row a document, of the strongest evidence role, the first of equal ones."""
    strength = F.array_position(F.array(*(F.lit(r) for r in ROLES)), F.col(role))
    w = W.partitionBy(*keys).orderBy(strength.desc(), order)
    return provenance.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def scoped_keys(candidates: DataFrame, items: DataFrame, scope: Sequence[tuple[str, str]]) -> DataFrame:
    """Q18: keys that exist already get a suffix from a hash of the scope columns (with their defaults)."""
    taken = items.select("stable_key").distinct().withColumn("_taken", F.lit(True))
    text = F.concat_ws("\x00", *(F.coalesce(F.col(c).cast("string"), F.lit(d)) for c, d in scope))
    suffix = F.concat(F.lit(".scope-"), F.substring(F.sha2(text, 256), 1, 12))
    made = F.concat(F.regexp_replace(F.substring("stable_key", 1, 160 - 19), "[._-]+$", ""), suffix)
    out = candidates.join(taken, "stable_key", "left")
    return out.withColumn("stable_key", F.when(F.col("_taken"), made).otherwise(F.col("stable_key"))).drop("_taken")


def trust(revisions: DataFrame, provenance: DataFrame, key: str) -> DataFrame:
    """Q19: distinct documents as confirmations; next review 90 days after verification of dangerous ones, else 180."""
    n = provenance.groupBy(key).agg(F.countDistinct("url", "content_hash").alias("confirmations"))
    days = F.when(F.col("dangerous"), 90).otherwise(180)
    return revisions.join(n, key, "left").select(key, F.coalesce("confirmations", F.lit(0)).alias("confirmations"), F.date_add("verified_at", days).alias("next_review"))


def slug(value: Column, limit: int = 63) -> Column:
    """Q20: lower case without accents, anything else as a dash."""
    plain = F.translate(F.lower(value), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.substring(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, limit)


def new_members(batch: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q21: distinct dimension members of a batch that aren't known."""
    return batch.select(*keys).distinct().join(known.select(*keys), list(keys), "left_anti")


def ledger(batch: DataFrame, old: DataFrame, key: str, level: str, trusted: Sequence[str]) -> DataFrame:
    """Q22: an import ledger: ``trust`` from the source's level, the newest import of a key replacing the old."""
    new = batch.select(key, F.when(F.col(level).isin(list(trusted)), "reviewed").otherwise("imported").alias("trust"), F.lit(1).alias("batch"))
    both = old.select(key, "trust", F.lit(0).alias("batch")).unionByName(new)
    return both.groupBy(key).agg(F.max_by("trust", "batch").alias("trust"))


def conservation(**counts: DataFrame) -> DataFrame:
    """Q23: one row with every table's count, and whether all are equal."""
    out = None
    for name, df in counts.items():
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.join(F.broadcast(one))
    names = list(counts)
    return out.withColumn("conserved", F.forall(F.array(*names), lambda x: x == F.col(names[0])))


def conformance(fixtures: DataFrame, found: Column, expected: str, rules: Sequence[str]) -> DataFrame:
    """Q24: by rule code the fixtures that expect it and those that meet it; a rule no fixture covers shows as 0."""
    codes = fixtures.sparkSession.range(1).select(F.explode(F.array(*(F.lit(r) for r in rules))).alias("code"))
    rows = fixtures.withColumn("_found", found)
    met = rows.select(F.explode("_found").alias("code")).groupBy("code").agg(F.count("*").alias("met"))
    want = rows.select(F.explode(expected).alias("code")).groupBy("code").agg(F.count("*").alias("expected"))
    out = codes.join(want, "code", "left").join(met, "code", "left")
    return out.select("code", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("met", F.lit(0)).alias("met"))


def canonical_hash(columns: Sequence[str]) -> Column:
    """Q25: a hash of the columns as JSON, sorted by name."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def safety_repairs(revisions: DataFrame, provenance: DataFrame, key: str, lines: Column) -> DataFrame:
    """Q27: dangerous-flagged revisions, each repaired or skipped with a reason."""
    level = T.risk(lines)
    proof = provenance.select(key).distinct().withColumn("_proof", F.lit(True))
    out = revisions.where("dangerous").join(proof, key, "left")
    action = F.when(level != "safe_read_only", "skip:not_read_only").when(F.col("_proof").isNull(), "skip:no_evidence").otherwise("repair")
    return out.select(key, action.alias("action"))


def bulk_repair(df: DataFrame, column: str, cond: Column, value: object) -> tuple[DataFrame, DataFrame]:
    """Q28: (the repaired table, the rows it changes as they were)."""
    return df.withColumn(column, F.when(cond, F.lit(value)).otherwise(F.col(column))), df.where(cond)


def completeness(leased: DataFrame, submitted: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """Q30: one row: leased fragments without an answer, answers that weren't leased, and whether the batch is whole."""
    answered = submitted.select(key).unionByName(rejected.select(key)).distinct()
    missing = leased.select(key).join(answered, key, "left_anti").agg(F.count("*").alias("missing"))
    extra = answered.join(leased.select(key), key, "left_anti").agg(F.count("*").alias("extra"))
    return missing.join(F.broadcast(extra)).withColumn("complete", (F.col("missing") == 0) & (F.col("extra") == 0))


def rebound(candidates: DataFrame, sources: DataFrame, terms: str = "terms") -> DataFrame:
    """Q31: candidates of a relevant source, with its URL and hash, one for each content hash (first id);
    ``sources`` is (source_id, url, source_hash, terms)."""
    both = candidates.join(sources, "source_id").where(T.relevant(F.col("text"), F.col(terms)))
    w = W.partitionBy(F.sha2("text", 256)).orderBy("candidate_id")
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", terms)


# Shapes of leaked secrets.
LEAKS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "bearer": r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]{16,}",
    "token": r"\b(?:sk|ghp|gho|xox[abp])[-_][A-Za-z0-9_-]{16,}|\bAKIA[0-9A-Z]{16}\b",
}


def leaks(text: Column) -> Column:
    """Q32: the kinds of secrets that a text shows."""
    return issues({k: text.rlike(p) for k, p in LEAKS.items()})


def leaked_values(records: DataFrame, values: DataFrame, key: str, text: str, max_values: int = 1000) -> DataFrame:
    """Q32: records that contain one of the known values; at most ``max_values`` of them are accepted."""
    if values.limit(max_values + 1).count() > max_values:
        raise ValueError(f"more than {max_values} values")
    known = F.broadcast(values.select(F.col(values.columns[0]).alias("_value")).where(F.length("_value") >= 8))
    return records.join(known, F.contains(F.col(text), F.col("_value"))).select(key).distinct()


# --- extension surface (X) -----------------------------------------------------------


class Pack:
    """A domain pack: a manifest, and rules as columns. Subclasses override what they need."""

    name, version, needs = "core", "1.0.0", ">=1.0.0"

    def context(self, df: DataFrame) -> DataFrame:
        """Normalises the context columns."""
        return df

    def rules(self) -> Column:
        """Issue codes of a record."""
        return gate()

    def validate(self, df: DataFrame) -> DataFrame:
        """Records with their ``issues`` and ``valid``."""
        return self.context(df).withColumn("issues", self.rules()).withColumn("valid", F.size("issues") == 0)


class MeasurementPack(Pack):
    """Measurement records."""

    name, version = "engineering-measurements", "1.1.0"

    def rules(self) -> Column:
        return measurement_rules()


def extracted(fragments: DataFrame, key: str, content: str = "content") -> DataFrame:
    """Candidates from fragments: command, key, kind, risk and danger. A table function as a frame to frame map."""
    # outer, as the other form tests the lines for emptiness, which computes them again
    rows = fragments.select(key, F.posexplode_outer(T.command_lines(F.col(content))).alias("place", "command")).where("command is not null")
    level = T.risk(F.array("command"))
    name = F.concat(F.lit("reference."), F.substring(F.regexp_replace(F.regexp_replace(F.lower("command"), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 80))
    kind = F.when(level == "safe_read_only", "diagnostic").otherwise("command")
    return rows.select(key, "place", "command", name.alias("stable_key"), kind.alias("kind"), level.alias("risk_level"), (level != "safe_read_only").alias("dangerous"))


def compatible(version: Column, wanted: Column) -> Column:
    """A semantic version is at least the wanted one and of the same major."""
    part = lambda v, i: F.regexp_extract(v, r"^([0-9]+)\.([0-9]+)\.([0-9]+)", i).try_cast("int")
    key = lambda v: F.array(part(v, 1), part(v, 2), part(v, 3))
    return (part(version, 1) == part(wanted, 1)) & (key(version) >= key(wanted))


def installed(manifests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Manifests enabled in the catalogue under a compatible version."""
    c = catalogue.where("enabled").select("name", F.col("version").alias("_wanted"))
    return manifests.join(c, "name").where(compatible(F.col("version"), F.col("_wanted"))).drop("_wanted")


def redact_json(df: DataFrame, column: str, secret_keys: Sequence[str], mask_all: bool = False, depth: int = 8, items: int = 200, chars: int = 8000) -> DataFrame:
    """The JSON column with secret keys' values (or every leaf) masked, bounded in depth, items and
    string length. Broken JSON is masked whole; null stays null."""
    import json

    secret = {k.lower() for k in secret_keys}

    def walk(x, d):
        if isinstance(x, dict):
            if d >= depth:
                return "[TRUNCATED]"
            return {k: "[REDACTED]" if k.lower() in secret else walk(v, d + 1) for k, v in list(x.items())[:items]}
        if isinstance(x, list):
            return "[TRUNCATED]" if d >= depth else [walk(v, d + 1) for v in x[:items]]
        if mask_all and x is not None:
            return "[MASKED]"
        return x[:chars] if isinstance(x, str) else x

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return json.dumps(walk(json.loads(text), 0), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return '"[REDACTED]"'

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(one, na_action="ignore")

    return df.withColumn(column, mask(F.col(column)))


def masked_table(df: DataFrame, masks: Mapping[str, object]) -> DataFrame:
    """Identity columns as constants of their type; the shape of rows stays, nulls stay null."""
    return df.select(*(F.when(F.col(n).isNotNull(), F.lit(masks[n]).cast(k)).alias(n) if n in masks else F.col(n) for n, k in df.dtypes))


# Document roles by their wire names.
DOCUMENT_ROLES = {
    "command": "commands",
    "commands": "commands",
    "command-reference": "commands",
    "cli-reference": "commands",
    "configuration": "configuration",
    "configuration-guide": "configuration",
    "diagnostic": "diagnostics",
    "diagnostics": "diagnostics",
    "troubleshooting": "diagnostics",
    "upgrade": "upgrades",
    "upgrades": "upgrades",
    "upgrade-guide": "upgrades",
    "security": "security_advisories",
    "advisory": "security_advisories",
    "security-advisory": "security_advisories",
    "security-advisories": "security_advisories",
    "release-note": "release_notes",
    "release-notes": "release_notes",
}


def normalised_diagnoses(df: DataFrame, capabilities: str, roles: str, context: Sequence[str]) -> DataFrame:
    """Q29: capabilities as slugs, document roles by their known names (others stay), blank context texts as null."""
    table = F.create_map(*(F.lit(x) for kv in DOCUMENT_ROLES.items() for x in kv))
    topic = lambda x: F.when(T.trimmed(x) != "", slug(x)).otherwise(x)
    out = df.withColumn(capabilities, F.transform(capabilities, topic)).withColumn(roles, F.transform(roles, lambda x: F.coalesce(table[slug(x)], x)))
    return out.withColumns({c: F.nullif(T.trimmed(F.col(c)), F.lit("")) for c in context})


def current_validation(validations: DataFrame, as_of: Column, levels: Sequence[str]) -> DataFrame:
    """A revision's current validation as a table: passed, unexpired, of the strongest level, then the latest."""
    valid = validations.where((F.col("status") == "passed") & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of)))
    level = F.array_position(F.array(*(F.lit(x) for x in levels)), F.col("validation_type"))
    w = W.partitionBy("revision_id").orderBy(F.when(level > 0, level).otherwise(len(levels) + 1), F.desc("executed_at"))
    return valid.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


# Order of validation levels; others come after.
VALIDATION_LEVELS = ("runtime_lab_validated", "batfish_modeled")


def register_current_validation(validations: DataFrame, levels: Sequence[str] = VALIDATION_LEVELS, name: str = "current_knowledge_validation") -> None:
    """X5 as a SQL table function of the session: ``name(revision_id, as_of)`` returns (validation_level, lab_validated_at) of the passed
    validation that expires after ``as_of``, of the strongest level, then the latest; a row at most.

    Called by LATERAL for each revision, it is one aggregate over ``validations`` (revision_id, status, validation_type, executed_at,
    expires_at) and one join. The best row is an aggregate, as a LIMIT inside a table function is taken over all calls at once. An
    expiry of null is none that lies after ``as_of``.
    """
    spark, view = validations.sparkSession, f"{name}_rows"
    validations.createOrReplaceTempView(view)
    kinds = dict(validations.dtypes)
    order = " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(levels))
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(requested {kinds['revision_id']}, as_of {kinds['expires_at']})
        RETURNS TABLE (validation_level STRING, lab_validated_at {kinds['executed_at']})
        RETURN SELECT best.level, best.at FROM (
            SELECT min_by(named_struct('level', validation_type, 'at', executed_at), named_struct('a', CASE validation_type {order} ELSE {len(levels)} END, 'b', -unix_micros(CAST(executed_at AS TIMESTAMP)), 'c', validation_type)) AS best
            FROM {view} WHERE revision_id = requested AND status = 'passed' AND expires_at > as_of) WHERE best IS NOT NULL""")
