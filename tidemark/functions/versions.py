"""Version strings as integer arrays, their order, branches and applicability (inventory V)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts kept, cap of a number, base of letter parts.
PARTS, NUMBER_CAP, LETTER_BASE = 16, 2_000_000_000, 1_000_000_000

# Portable families by operating system.
PORTABLE = {
    "onie": "onie",
    "sonic": "sonic",
    "openwrt": "openwrt",
    "openwrt-gl-inet-firmware": "openwrt",
    "linux": "linux-userspace",
    "linux-iproute2": "linux-iproute2",
    "linux-netfilter": "linux-netfilter",
    "cumulus-linux": "cumulus-linux",
    "cumulus-linux-nvue": "cumulus-linux",
    "nvidia-cumulus-linux": "cumulus-linux",
}


def parts(version: Column) -> Column:
    """V1: numbers (capped) and letter runs (base 27 over six letters, above all small numbers), 16 at most; null stays null."""
    found = F.slice(F.regexp_extract_all(F.lower(version), F.lit("([0-9]+|[a-z]+)"), 1), 1, PARTS)

    def one(p: Column) -> Column:
        number = F.when(F.length(F.ltrim(p, F.lit("0"))) > 10, F.lit(NUMBER_CAP)).otherwise(F.least(p.try_cast("long"), F.lit(NUMBER_CAP)))
        letters = F.aggregate(F.split(F.substring(p, 1, 6), ""), F.lit(0).cast("long"), lambda a, x: a * 27 + F.ascii(x) - 96)
        return F.when(p.rlike("^[0-9]"), number).otherwise(letters + LETTER_BASE).cast("long")

    return F.transform(found, one)


def padded(version: Column, width: int = PARTS) -> Column:
    """V2: an array filled up with zeros, so that array order is version order."""
    return F.concat(version, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(version)))


def compare(left: Column, right: Column) -> Column:
    """V2: -1, 0 or 1; missing parts count as 0."""
    a, b = padded(left), padded(right)
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def applicable(version: Column, low: Column, high: Column) -> Column:
    """V3: within the bounds; null bounds and a null version are open."""
    above = low.isNull() | (compare(version, low) >= 0)
    return version.isNull() | (above & (high.isNull() | (compare(version, high) <= 0)))


def branch(version: Column, strategy: Column) -> Column:
    """V4: ``major.minor``, or ``yyyy.mm`` of six to eight digits under the calendar strategy; else null."""
    numbers = F.regexp_extract_all(version, F.lit("([0-9]+)"), 1)
    dated = (strategy == "calendar") & version.rlike("^[0-9]{6,8}$")
    two = F.concat_ws(".", F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1)))
    return F.when(dated, F.concat_ws(".", F.substring(version, 1, 4), F.substring(version, 5, 2))).when(strategy.isin("calendar", "major_minor", "semantic") & (F.size(numbers) >= 2), two)


def match(requested: Column, low: Column, high: Column, scope: Column, record_branch: Column, strategy: Column) -> Column:
    """V5: how a record's version scope answers a requested version; null: not at all."""
    want = parts(requested)
    inside = (low.isNull() | (compare(want, low) >= 0)) & (high.isNull() | (compare(want, high) <= 0))
    same = F.coalesce(branch(requested, strategy) == record_branch, F.lit(False))
    exact = F.coalesce((compare(want, low) == 0) & (compare(want, high) == 0), F.lit(False))
    unasked = requested.isNull() | (requested == "")
    return (
        F.when(scope == "unbounded", "unbounded")
        .when(unasked, "branch")
        .when(scope == "range", F.when(inside, "explicit_range"))
        .when(scope == "branch", F.when(branch(requested, strategy).eqNullSafe(record_branch), "branch"))
        .when(exact, "exact")
        .when(same, "same_branch_fallback")
    )


def assurance(scope: Column, version_match: Column) -> Column:
    """V6."""
    return F.when(version_match == "same_branch_fallback", "best_effort").when((scope == "model") & (version_match == "exact"), "exact").when(scope == "os_family", "generic").otherwise("compatible")


def match_level(scope: Column) -> Column:
    """V6."""
    levels = {"model": "exact_model", "vendor_os": "vendor_os", "architecture": "architecture_os"}
    return F.coalesce(*(F.when(scope == k, v) for k, v in levels.items()), F.lit("os_family"))


def family_slug(vendor: Column, os: Column) -> Column:
    """V8: the portable family of an operating system, else one made of vendor and system; a name of more
    than 55 characters is cut and gets seven digits of a hash."""
    table = F.create_map(*(F.lit(x) for kv in PORTABLE.items() for x in kv))
    own = F.when((vendor == "cisco") & os.isin("nx-os", "ios-xe"), F.concat(F.lit("cisco-"), os))
    readable = F.regexp_replace(F.regexp_replace(F.lower(F.concat(vendor, F.lit("-"), os)), "[^a-z0-9-]+", "-"), "^-+|-+$", "")
    readable = F.substring(readable, 1, 63)
    digits = F.substring(F.sha2(F.concat(vendor, F.lit("\x00"), os), 256), 1, 7)
    made = F.when(F.length(readable) <= 55, readable).otherwise(F.concat(F.substring(readable, 1, 55), F.lit("-"), digits))
    return F.coalesce(table[os], F.when(F.contains(os, F.lit("cumulus-linux")), "cumulus-linux"), own, made)


def semantic_key(kind: Column, portable_key: Column, command: Column, procedure: Column, title: Column) -> Column:
    """V9: a hash of the kind and of the first of portable key, command, procedure lines and title."""
    steps = F.when(F.size(procedure) > 0, F.array_join(procedure, "\n"))
    text = F.lower(F.concat_ws("\x00", kind, F.coalesce(F.nullif(portable_key, F.lit("")), command, steps, title)))
    return F.sha2(F.trim(F.regexp_replace(text, r"[\s ﻿]+", " ")), 256)
