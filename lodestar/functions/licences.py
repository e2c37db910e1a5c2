"""Licences and sentences: ordered pattern cascades as CASE chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Licence patterns in order, compounds first; abbreviations after which no sentence ends.
PATTERNS = [
    (r"by[-_ ]nc[-_ ]nd", "cc-by-nc-nd"), (r"by[-_ ]nc[-_ ]sa", "cc-by-nc-sa"), (r"by[-_ ]nc", "cc-by-nc"), (r"by[-_ ]nd", "cc-by-nd"), (r"by[-_ ]sa", "cc-by-sa"),
    (r"publicdomain/zero|cc0", "cc0"), (r"licenses/by/|cc[-_ ]by", "cc-by"), (r"text[- ]and[- ]data[- ]mining", "tdm"),
]
ABBREVIATIONS = "vs cf eg ie al fig figs no ca approx etc dr prof st mg kg ml yr yrs min max ref".split()


def code(reference: Column) -> Column:
    """The first pattern that a reference holds."""
    low, out = F.lower(F.coalesce(reference, F.lit(""))), None
    for pattern, name in PATTERNS:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out.otherwise("")


def band(code_: Column, reference: Column) -> Column:
    """Open, cc-restrictive, tdm, none (blank) or other."""
    return F.when(code_.isin("cc-by", "cc-by-sa", "cc0"), "open").when(code_ == "tdm", "tdm").when(code_ != "", "cc-restrictive").when(F.trim(F.coalesce(reference, F.lit(""))) == "", "none").otherwise("other")


def sentences(text: Column) -> Column:
    """Split after an end mark before a capital, digit or bracket; parts after an abbreviation are joined again."""
    parts = F.split(F.trim(text), r"(?<=[.!?])\s+(?=[A-Z0-9(])")
    last = lambda s: F.lower(F.regexp_replace(F.element_at(F.split(s, r"\s+"), -1), r"^[(,;:]+|[.),;:]+$", ""))
    join = lambda acc, s: F.when((F.size(acc) > 0) & last(F.element_at(acc, -1)).isin(ABBREVIATIONS), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.element_at(acc, -1), s)))).otherwise(F.concat(acc, F.array(s)))
    merged = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when(F.size(acc) == 0, F.array(s)).otherwise(join(acc, s)))
    return F.filter(merged, lambda s: F.trim(s) != "")
