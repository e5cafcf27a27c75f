"""A search that proves absence on raw lines before anything is parsed."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Short escapes of JSON strings.
SHORT = {'"': '\\"', "\\": "\\\\", "/": "\\/", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


@cache
def _uppers() -> dict[str, tuple[str, ...]]:
    """For each character those that lower-casing turns into it, itself included; the final sigma is one of them."""
    found: dict[str, list[str]] = {}
    for x in map(chr, range(0x110000)):
        low = x.lower()
        if low != x and len(low) == 1:
            found.setdefault(low, []).append(x)
    found.setdefault("ς", []).append("Σ")
    return {k: tuple(v) for k, v in found.items()}


def _forms(char: str) -> list[str]:
    """How a character may stand in a JSON text, as patterns."""
    code = char.encode("utf-16-be").hex()
    escaped = "".join(rf"\\u(?i:{code[i : i + 4]})" for i in range(0, len(code), 4))
    return [re.escape(char), escaped, *([re.escape(SHORT[char])] if char in SHORT else [])]


def raw_pattern(needle: str) -> str:
    """A pattern that every JSON text matches that holds ``needle`` in a string, whatever the case of its letters and however they are escaped.

    A text without a match surely doesn't hold it. The dotted capital I, whose lower case is two characters, counts as a match wherever the needle has either.
    """
    low = needle.lower()
    parts = ["(?:" + "|".join(f for x in (c, *_uppers().get(c, ())) for f in _forms(x)) + ")" for c in low]
    odd = "|".join(_forms("İ")) if "i" in low or "̇" in low else ""
    return "".join(parts) + (f"|{odd}" if odd else "")


def may_hold(value: Column, needle: str) -> Column:
    """False only where a raw line surely doesn't hold the needle."""
    return value.rlike(raw_pattern(needle)) if needle else F.lit(True)


def search_recordings(records: DataFrame, needle: str, turns_of: Callable[[DataFrame], DataFrame], search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``search`` of the turns of those recordings alone that hold a line without proof of absence; the others are never parsed.

    ``records``: file, line, value. A recording is read whole or not at all, so its turns keep their numbers.
    """
    open_ = records.filter(may_hold(F.col("value"), needle)).select("file").distinct()
    return search(turns_of(records.join(open_, "file", "left_semi")))
