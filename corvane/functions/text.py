"""Text scalars as Column expressions.

All of them treat null as the empty string, and lengths are in code points.
"""

from __future__ import annotations

import html
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Python's str.split sees it: Java's \s lacks U+001C to U+001F, U+0085
#: and the space separators.
WHITE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\p{Z}]+"

# The coarse classes of the fine event types. passenger_assistance has
# none and passes through, as any other value does.
COARSE = {
    "not_relevant": "not_relevant",
    "hazmat_mobility_device": "hazmat_mobility_device",
    "maintenance_readiness": "maintenance_readiness",
    "baggage_cargo_weight_balance": "baggage_cargo",
    "cabin_service": "cabin_gate_passenger",
    "gate_or_boarding": "cabin_gate_passenger",
    "jetway_or_gate_infrastructure": "cabin_gate_passenger",
    "pushback_towing_chocks": "ramp_servicing",
    "ramp_ground_handling": "ramp_servicing",
    "other_ground_operation": "ramp_servicing",
    "fueling": "ramp_servicing",
    "dispatch_or_coordination": "ramp_servicing",
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_of(c: Column | str) -> Column:
    """c as a string, null as the empty one."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def collapse(c: Column | str) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text_of(c), WHITE, " "))


@F.pandas_udf(StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape)


def unescape(c: Column | str) -> Column:
    """HTML entities decoded, also those without a semicolon. There is no builtin for
    it, so a vectorised UDF does."""
    return _unescape(text_of(c))


def clean_text(c: Column | str, entities: bool = True) -> Column:
    """Entities decoded, then tags made spaces, then white space collapsed. Decoding
    comes first, so an escaped tag is a tag; what stands inside script and style
    elements stays. entities=False skips the UDF for texts known to have none."""
    decoded = unescape(c) if entities else text_of(c)
    return collapse(F.regexp_replace(decoded, "<[^>]+>", " "))


def normalize_text(c: Column | str) -> Column:
    return F.lower(collapse(c))


def text_hash(c: Column | str) -> Column:
    """SHA-256 of the normalised text."""
    return F.sha2(normalize_text(c), 256)


def text_length(c: Column | str) -> Column:
    """Length of the text as it is."""
    return F.length(text_of(c))


def year_from_value(c: Column | str) -> Column:
    """The first four characters as a year if they are digits, else null."""
    return F.nullif(F.regexp_extract(text_of(c), r"^([0-9]{4})", 1), F.lit("")).cast("int")


def in_year_window(c: Column | str, first: int, last: int) -> Column:
    """Whether the first four characters read as a whole number in the range. Unlike
    year_from_value, blanks around the digits are let pass; never null."""
    head = F.substring(text_of(c), 1, 4)
    return F.coalesce(F.when(F.length(head) == 4, head.try_cast("int")).between(first, last), F.lit(False))


def contains_any(lowered: Column, terms: list[str] | tuple[str, ...]) -> Column:
    """Whether any term is a substring: no word bounds, terms in lower case. A search for
    bytes each, which takes a fraction of what a regular expression of all terms does."""
    return reduce(lambda a, b: a | b, [lowered.contains(t) for t in terms], F.lit(False))


def first_position(lowered: Column, terms: Column) -> Column:
    """Least place from 1 of any term of an array, null if none occurs."""
    return F.array_min(F.filter(F.transform(terms, lambda t: F.instr(lowered, t)), lambda p: p > 0))


def snippet(c: Column | str, terms: Column, before: int = 45, length: int = 140) -> Column:
    """The text around the first of the terms, white space collapsed; "" without one."""
    text = text_of(c)
    at = first_position(F.lower(text), terms)
    return F.coalesce(collapse(F.substring(text, F.greatest(F.lit(1), at - before), F.lit(length))), F.lit(""))


def safe_snippet(c: Column | str, most: int = 180) -> Column:
    """White space collapsed, and cut to `most` characters with an ellipsis."""
    v = collapse(c)
    return F.when(F.length(v) <= most, v).otherwise(F.concat(F.rtrim(F.substring(v, 1, most - 3)), F.lit("...")))


def record_text(synopsis: Column | str, people: Column | str, entities: bool = True) -> tuple[Column, Column, Column]:
    """(synopsis, narrative, all text) of a record. The narrative joins, for each person
    in order, field 9107 and, unless it is empty, field 11330, by single spaces; an
    empty narrative keeps its separator."""
    syn = clean_text(synopsis, entities)
    # One string per record passes through the UDF: parts are joined by a character that
    # cleaning cannot make or remove, so the parts are cleaned at once.
    people = F.coalesce(col(people), F.array().cast("array<struct<`9107`:string,`11330`:string>>"))
    mark = "⁣"
    raw = lambda x: F.translate(F.coalesce(x, F.lit("")), mark, "")
    parts = F.flatten(F.transform(people, lambda p: F.when(F.coalesce(p["11330"], F.lit("")) == "", F.array(raw(p["9107"]))).otherwise(F.array(raw(p["9107"]), raw(p["11330"])))))
    decoded = unescape(F.array_join(parts, mark)) if entities else F.array_join(parts, mark)
    cleaned = F.transform(F.split(decoded, mark, -1), lambda x: collapse(F.regexp_replace(x, "<[^>]+>", " ")))
    narrative = F.when(F.size(people) == 0, F.lit("")).otherwise(F.array_join(cleaned, " "))
    return syn, narrative, F.trim(F.concat_ws(" ", syn, narrative))


def content_lengths(synopsis: Column, narrative: Column, all_text: Column) -> tuple[Column, Column, Column]:
    """Lengths of all text, synopsis and narrative without blanks at the ends; 0 for null."""
    size = lambda c: F.coalesce(F.length(F.trim(c)), F.lit(0))
    return size(all_text), size(synopsis), size(narrative)


def approx_tokens(c: Column | str) -> Column:
    """A quarter of the length, rounded half to even, 1 at least."""
    return F.greatest(F.lit(1), F.rint(F.length(text_of(c)) / 4).cast("int"))


def label_set(c: Column | str) -> Column:
    """The non-empty parts between semicolons."""
    return F.filter(F.split(text_of(c), ";"), lambda x: x != "")


def event_labels(primary: Column | str, secondary: Column | str) -> Column:
    """Primary, then secondary labels, trimmed; no blanks, no not_relevant, no repeats."""
    every = F.concat(F.array(F.trim(text_of(primary))), F.transform(F.split(text_of(secondary), ";"), lambda x: F.trim(x)))
    return F.array_distinct(F.filter(every, lambda x: ~x.isin("", "not_relevant")))


def coarse_label(c: Column | str, classes: dict[str, str] | None = None) -> Column:
    pairs = [F.lit(x) for kv in (COARSE if classes is None else classes).items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), col(c)), col(c)) if pairs else col(c)


# How model names map to families, the first rule that fits. "start"
# tests the beginning, "part" any place.
FAMILY_RULES = (
    ("part", "majority", "Majority"),
    ("part", "qwen", "Remote Qwen structured output"),
    ("part", "supervised_minilm", "Supervised MiniLM"),
    ("start", "sbert", "Frozen MiniLM embeddings"),
    ("part", "logreg", "TF-IDF logistic regression"),
    ("part", "linear_svc", "TF-IDF LinearSVC"),
    ("part", "calibrated_svc", "TF-IDF LinearSVC"),
)


def model_family(c: Column | str, rules: tuple[tuple[str, str, str], ...] = FAMILY_RULES) -> Column:
    """Display family of a model name by ordered rules; else the name itself."""
    out = name = col(c)
    for kind, what, family in reversed(rules):
        out = F.when(name.startswith(what) if kind == "start" else name.contains(what), F.lit(family)).otherwise(out)
    return out


def format_ci(value: Column | str, low: Column | str, high: Column | str) -> Column:
    return F.format_string("%.3f [%.3f, %.3f]", col(value), col(low), col(high))
