"""Rewrite rules: one table of (pattern, replacement) serves Python texts and Spark columns alike.

Patterns use the syntax that Python and Java share, with inline flags; `column()` adapts the rest: Unicode classes, the end
of the text, and the spelling of group references.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = Iterable[tuple[str, str]]


def apply(text: str, rules: Rules) -> str:
    """The text after all rules, in order."""
    for pattern, replacement in rules:
        text = re.sub(pattern, replacement, text)
    return text


def java(pattern: str) -> str:
    """The pattern for Java: \\w, \\s and \\b by Unicode, \\Z as the very end, $ at line feeds only."""
    flags = "U" if re.search(r"\\[wWsSdDb]", pattern) else ""
    if "(?m)" in pattern or "(?im)" in pattern or "(?sm)" in pattern:
        flags += "d"
    return (f"(?{flags})" if flags else "") + pattern.replace(r"\Z", r"\z")


def column(value: Column, rules: Rules) -> Column:
    """The column after all rules, in order, within whole-stage code."""
    for pattern, replacement in rules:
        shown = re.sub(r"\\(\d)", r"$\1", replacement.replace("$", r"\$"))
        value = F.regexp_replace(value, F.lit(java(pattern)), F.lit(shown))
    return value
