"""Scalar rules of the session model as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a structural line of a rendered transcript begins with; such text lines get one more backslash.
STRUCTURAL = ("## ", "=== ", "[… ", "tool: ", "artifact: ")


def byte_size(text: Column) -> Column:
    """Bytes of ``64KiB``, ``8m`` (binary), ``1.5GB`` (decimal) or a plain count; null for anything else."""
    t = F.trim(text)
    number = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)\s*[A-Za-z]*$", 1)
    unit = F.lower(F.regexp_extract(t, r"^[0-9.]+\s*([A-Za-z]*)$", 1))
    power = F.when(unit.isin("", "b"), 0)
    for k, letter in enumerate("kmgt", 1):
        power = power.when(unit.rlike(f"^{letter}(i|ib|b)?$"), k)
    base = F.when(unit.rlike("^[kmgt]b$"), 1000.0).otherwise(1024.0)
    return F.when((number != "") & power.isNotNull(), F.floor(number.cast("double") * F.pow(base, power)).cast("long"))


def duration_ms(text: Column) -> Column:
    """Milliseconds of ``45m``, ``1h 30m``, ``2days``; null for anything else."""
    units = (("ms|msec|millis", 1), ("s|sec|secs|second|seconds", 1_000), ("m|min|mins|minute|minutes", 60_000), ("h|hr|hrs|hour|hours", 3_600_000), ("d|day|days", 86_400_000), ("w|week|weeks", 604_800_000))
    names = "|".join(n for n, _ in units)
    total = F.lit(0).cast("long")
    for name, ms in units:
        found = F.regexp_extract_all(text, F.lit(rf"([0-9]+)\s*(?:{name})(?![A-Za-z])"), 1)
        total = total + F.aggregate(F.transform(found, lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x) * ms
    return F.when(text.rlike(rf"^\s*([0-9]+\s*(?:{names})\s*)+$"), total)


def without_credentials(url: Column) -> Column:
    """A URL without the user and password before its host; addresses without a scheme stay."""
    return F.regexp_replace(url, r"^([^:]*(?:(?!://):[^:]*)*?://)[^/?#]*@([^/?#@]*)", "$1$2")


def single_line(text: Column) -> Column:
    """Control characters replaced by spaces."""
    return F.regexp_replace(text, r"[\x00-\x1F\x7F-\x9F]", " ")


def escaped(text: Column) -> Column:
    """Lines that could be taken for structure, or that begin with a backslash, get a backslash in front."""
    starts = "|".join(re.escape(x) for x in ("\\", *STRUCTURAL))
    return F.regexp_replace(text, f"(?m)^({starts})", r"\\$1")


def instant(text: Column) -> Column:
    """A time written as RFC 3339, a date, or seconds or milliseconds since 1970 (from 10^11 on), in UTC; null for anything else."""
    number = F.when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), text.cast("double"))
    seconds = F.when(F.abs(number) >= 1e11, number / 1000).otherwise(number)
    return F.coalesce(F.timestamp_micros((seconds * 1_000_000).cast("long")), F.try_to_timestamp(text)).cast("timestamp_ntz")


def json_shape(text: Column) -> Column:
    """The keys and types of a JSON value, its values left out; null for what isn't JSON."""
    return F.schema_of_variant(F.try_parse_json(text))


def byte_capped(text: Column, most: int) -> Column:
    """The longest prefix of whole characters within ``most`` bytes."""
    cut = F.substring(text.cast("binary"), 1, most)
    # a character that was cut leaves bytes that decode to replacements at the end: try its at most three places
    whole = [F.substring(text.cast("binary"), 1, most - k) for k in range(4) if most - k >= 0]
    valid = F.coalesce(*[F.when(F.is_valid_utf8(w.cast("string")), w.cast("string")) for w in whole], F.lit(""))
    return F.when(F.octet_length(text) <= most, text).when(F.octet_length(cut) >= 0, valid)


def line_digest(line: Column) -> Column:
    """A 64-bit digest of a line without trailing space; null for lines of punctuation and space alone."""
    trimmed = F.regexp_replace(line, r"\s+$", "")
    return F.when(~trimmed.rlike(r"^[\p{Punct}\s]*$"), F.conv(F.substring(F.sha2(trimmed, 256), 1, 16), 16, -10).cast("long"))


def line_digests(text: Column) -> Column:
    """Distinct digests of a text's lines."""
    return F.array_distinct(F.array_compact(F.transform(F.split(text, "\n"), line_digest)))


def launch_parent(text: Column, prefix: str) -> Column:
    """``harness, id`` that the first line of a prompt names after ``prefix``; null without or malformed."""
    first = F.regexp_extract(text, r"^([^\n]*)", 1)
    pattern = rf"^{prefix} (claude|codex|opencode|pi):([A-Za-z0-9_.-]{{1,256}})$"
    return F.when(first.rlike(pattern), F.struct(F.regexp_extract(first, pattern, 1).alias("harness"), F.regexp_extract(first, pattern, 2).alias("id")))
