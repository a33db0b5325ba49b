"""The rule classifier: lexicon categories, exclusions, secondary labels, evidence.

A Lexicon is data; classify() turns it into one struct expression that Spark compiles
as a whole, without a UDF.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import contains_any, snippet

INCLUDE, EXCLUDE, UNCERTAIN = "include_ground_cabin_event", "exclude_not_ground_or_cabin", "uncertain_needs_review"
#: All statuses of the protocol; the rules give the first three only.
STATUSES = (INCLUDE, EXCLUDE, UNCERTAIN, "include_multi_event", "exclude_insufficient_detail", "exclude_duplicate")
NOT_RELEVANT, OTHER = "not_relevant", "other_ground_operation"


@dataclass(frozen=True)
class Lexicon:
    """Terms are substrings in lower case.

    categories: label -> terms. priority: labels, the first hit is primary. strong:
    labels that outweigh airborne terms. allowed: primary -> secondary labels that it
    can have; a primary without an entry can have all. guards: (label, primaries or
    empty for all, terms): the secondary label needs one of the terms.
    """

    categories: dict[str, tuple[str, ...]]
    priority: tuple[str, ...]
    strong: tuple[str, ...]
    airborne: tuple[str, ...]
    context: tuple[str, ...]
    fallback: tuple[str, ...]
    ignored: tuple[str, ...]
    assistance: str
    ground: tuple[str, ...]
    cabin: tuple[str, ...]
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)
    guards: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = ()


# Label names, their priority and groups, and which labels may follow which.
PRIORITY = (
    "hazmat_mobility_device",
    "jetway_or_gate_infrastructure",
    "other_ground_operation",
    "pushback_towing_chocks",
    "gate_or_boarding",
    "ramp_ground_handling",
    "baggage_cargo_weight_balance",
    "fueling",
    "cabin_service",
    "passenger_assistance",
    "maintenance_readiness",
    "dispatch_or_coordination",
)
STRONG = (
    "hazmat_mobility_device",
    "jetway_or_gate_infrastructure",
    "pushback_towing_chocks",
    "ramp_ground_handling",
    "baggage_cargo_weight_balance",
    "fueling",
    "maintenance_readiness",
    "gate_or_boarding",
    "other_ground_operation",
)
GROUND = (
    "pushback_towing_chocks",
    "ramp_ground_handling",
    "jetway_or_gate_infrastructure",
    "gate_or_boarding",
    "baggage_cargo_weight_balance",
    "fueling",
    "maintenance_readiness",
    "dispatch_or_coordination",
    "other_ground_operation",
)
CABIN = ("hazmat_mobility_device", "passenger_assistance", "cabin_service", "gate_or_boarding")
_GATE = ("hazmat_mobility_device", "pushback_towing_chocks", "fueling", "maintenance_readiness", "dispatch_or_coordination", "cabin_service")
ALLOWED = {
    "hazmat_mobility_device": ("pushback_towing_chocks", "fueling", "maintenance_readiness", "dispatch_or_coordination", "cabin_service"),
    "pushback_towing_chocks": ("hazmat_mobility_device", "baggage_cargo_weight_balance", "fueling", "maintenance_readiness", "dispatch_or_coordination", "cabin_service"),
    "ramp_ground_handling": ("pushback_towing_chocks", "baggage_cargo_weight_balance", "fueling", "maintenance_readiness", "gate_or_boarding", "hazmat_mobility_device"),
    "baggage_cargo_weight_balance": ("hazmat_mobility_device", "pushback_towing_chocks", "fueling", "maintenance_readiness", "dispatch_or_coordination"),
    "gate_or_boarding": _GATE,
    "jetway_or_gate_infrastructure": _GATE,
    "passenger_assistance": _GATE,
}

# The aviation lexicon.
AVIATION = Lexicon(
    categories={
        "hazmat_mobility_device": ("wheelchair", "wheel chair", "scooter", "lithium", "battery", "dangerous goods", "hazmat", "notoc", "dg "),
        "passenger_assistance": ("passenger assist", "special assist", "wheelchair", "mobility", "boarding assistance"),
        "jetway_or_gate_infrastructure": ("jetway", "jet bridge", "gate marking", "gate number", "walkway", "lead-in line", "lead in line"),
        "gate_or_boarding": ("gate agent", "boarding", "deboarding", "deplan", "cabin door", "entry door", "boarding door", "aircraft door", "ramp door"),
        "pushback_towing_chocks": ("pushback", "push back", "towbar", "tow bar", "tug", "towing", "tow ", "chock", "pushed"),
        "ramp_ground_handling": ("ramp", "ground crew", "ground personnel", "ground agent", "ground handling", "ramp agent", "marshaller", "marshalling", "marshal", "gse", "ground equipment", "belt loader", "vehicle", "truck"),
        "baggage_cargo_weight_balance": ("baggage", "bag ", "bags ", "cargo", "load closeout", "load sheet", "weight and balance", "weight/balance", "uld"),
        "fueling": ("fueling", "refuel", "fuel truck", "fuel spill", "fueler"),
        "maintenance_readiness": ("maintenance", "mechanic", "mel", "minimum equipment list", "defect", "deferred", "aircraft swap"),
        "dispatch_or_coordination": ("dispatch", "operations", "coordinat", "communicat", "company", "station"),
        "cabin_service": ("catering", "cleaning", "lavatory", "galley", "trash", "cabin service"),
        "other_ground_operation": ("taxiway", "taxi clearance", "taxiing", "runway incursion", "runway excursion", "movement area", "taxiway excursion", "wrong taxiway", "ground frequency", "tower frequency"),
    },
    priority=PRIORITY,
    strong=STRONG,
    airborne=(
        "wake turbulence", "during cruise", "during flight", "enroute", "en route", "climb", "descent", "approach", "final approach", "departure climb",
        "diversion", "diverted", "hydraulic", "navigation system", "cabin altitude", "cabin rate", "pressurization", "fume event", "fumes event", "physiological symptoms",
        "turbulence", "loss of hydraulic", "low engine oil", "engine power loss", "landing gear", "heavy vibrations", "autopilot", "ils", "localizer", "runway condition",
    ),
    context=(
        "gate", "ramp", "pushback", "push back", "taxi", "tow", "tug", "chock", "jetway", "jet bridge", "boarding",
        "deboarding", "preflight", "before departure", "maintenance", "cargo", "baggage", "wheelchair", "mobility", "battery", "ground crew", "ground personnel",
    ),
    fallback=("taxi", "gate", "ramp", "ground", "airport"),
    ignored=("precision runway monitor",),
    assistance="passenger_assistance",
    ground=GROUND,
    cabin=CABIN,
    allowed=ALLOWED,
    guards=(
        ("dispatch_or_coordination", (), ("dispatch", "operations", "coordinat")),
        ("maintenance_readiness", ("hazmat_mobility_device", "passenger_assistance"), ("mel", "minimum equipment list", "deferred", "aircraft swap", "maintenance delay")),
    ),
)

#: The same rules over substrings that occur in invented prose, for data without any
#: aviation in it.
INVENTED = Lexicon(
    categories={
        "hazmat_mobility_device": ("license", "token"),
        "passenger_assistance": ("thble", "los "),
        "jetway_or_gate_infrastructure": ("reou",),
        "gate_or_boarding": ("thhe", "eaea"),
        "pushback_towing_chocks": ("ciónco", "oror"),
        "ramp_ground_handling": ("thor", "thti"),
        "baggage_cargo_weight_balance": ("lynt", "ornt"),
        "fueling": ("tiin", "tier"),
        "maintenance_readiness": ("ungs", "eron"),
        "dispatch_or_coordination": ("thre", "than"),
        "cabin_service": ("thnt", "oument"),
        "other_ground_operation": ("thin",),
    },
    priority=PRIORITY,
    strong=STRONG,
    airborne=("die ", "los ", "anea", "et "),
    context=("und ", "que ", "of "),
    fallback=("tion", "der "),
    ignored=("thes",),
    assistance="passenger_assistance",
    ground=GROUND,
    cabin=CABIN,
    allowed=ALLOWED,
    guards=(("dispatch_or_coordination", (), ("thre",)), ("maintenance_readiness", ("hazmat_mobility_device", "passenger_assistance"), ("eron",))),
)


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def hits(lowered: Column, lexicon: Lexicon) -> Column:
    """Labels, in the lexicon's order, with a term in the text less ignored phrases."""
    for phrase in lexicon.ignored:
        lowered = F.replace(lowered, F.lit(phrase), F.lit(""))
    found = lambda t: F.array(*[F.when(contains_any(t, terms), F.lit(label)) for label, terms in lexicon.categories.items()])
    return F.filter(F.transform(F.array(lowered), found)[0], lambda x: x.isNotNull())  # the phrases go once, not for each term


def secondary_labels(primary: Column, ordered: Column, lowered: Column, lexicon: Lexicon) -> Column:
    """The labels after the primary one that stand for events of their own."""
    rest = F.slice(ordered, 2, max(1, len(lexicon.priority)))
    pairs = [x for k, v in lexicon.allowed.items() for x in (F.lit(k), _strings(v))]
    allowed = F.element_at(F.create_map(*pairs), primary) if pairs else F.lit(None).cast("array<string>")
    out = F.filter(rest, lambda x: allowed.isNull() | F.array_contains(allowed, x))
    for label, primaries, terms in lexicon.guards:
        bound = primary.isin(*primaries) if primaries else F.lit(True)
        lacks = bound & ~contains_any(lowered, terms)
        out = F.when(lacks, F.array_remove(out, label)).otherwise(out)
    return out


RESULT = "screening_status string, primary_event_type string, secondary_event_types string, multi_event_flag string, ground_evidence string, cabin_evidence string, exclusion_reason string"


def classify(df: DataFrame, lexicon: Lexicon = AVIATION, synopsis: str = "synopsis", text: str = "all_text") -> DataFrame:
    """df with the columns of RESULT and the arrays synopsis_hits, hits and secondaries.

    Steps are columns of successive projections, so that each text is lowered and
    searched once; all of it runs in one stage. Hits of the synopsis hide those of the
    whole text. An airborne synopsis without a strong hit excludes, and so does
    assistance as the primary label without ground context in the synopsis.
    """
    syn, all_ = F.lower(F.coalesce(F.col(synopsis), F.lit(""))), F.lower(F.coalesce(F.col(text), F.lit("")))
    base = df.columns
    df = df.select("*", syn.alias("__syn"), all_.alias("__all"))
    df = df.select("*", hits(F.col("__syn"), lexicon).alias("synopsis_hits"), hits(F.col("__all"), lexicon).alias("__every"), contains_any(F.col("__syn"), lexicon.airborne).alias("__air"), contains_any(F.col("__syn"), lexicon.context).alias("__ctx"), contains_any(F.col("__all"), lexicon.fallback).alias("__fall"))
    df = df.select("*", F.array_intersect(_strings(lexicon.priority), F.when(F.size("synopsis_hits") > 0, F.col("synopsis_hits")).otherwise(F.col("__every"))).alias("hits"))
    first = F.when(F.size("hits") > 0, F.element_at("hits", 1))
    reason = (
        F.when(F.col("__air") & ~F.arrays_overlap("synopsis_hits", _strings(lexicon.strong)), F.lit("airborne_or_non_ground_context_only"))
        .when((first == lexicon.assistance) & ~F.col("__ctx"), F.lit("passenger_assistance_not_ground_phase"))
        .when(first.isNull() & ~F.col("__fall"), F.lit("no_ground_cabin_keyword_evidence"))
        .otherwise(F.lit(""))
    )
    df = df.select("*", reason.alias("exclusion_reason"))
    out = F.col("exclusion_reason") != ""
    primary = F.when(out, F.lit(NOT_RELEVANT)).otherwise(F.coalesce(first, F.lit(OTHER)))
    status = F.when(out, F.lit(EXCLUDE)).when(first.isNull(), F.lit(UNCERTAIN)).otherwise(F.lit(INCLUDE))
    df = df.select("*", status.alias("screening_status"), primary.alias("primary_event_type"))
    second = F.when(out | (F.size("hits") == 0), F.array().cast("array<string>")).otherwise(secondary_labels(F.col("primary_event_type"), F.col("hits"), F.col("__all"), lexicon))
    df = df.select("*", second.alias("secondaries"))

    def terms(group: tuple[str, ...]) -> Column:
        """Terms of the hit labels of a group; a fallback label stands in without hits."""
        pairs = [x for label in group for x in (F.lit(label), _strings(lexicon.categories.get(label, ())))]
        known = F.create_map(*pairs)
        labels = F.when(F.size("hits") > 0, F.col("hits")).otherwise(F.array("primary_event_type"))
        return F.flatten(F.transform(F.filter(labels, lambda x: x.isin(*group)), lambda x: F.element_at(known, x)))

    evidence = lambda group: F.when(out, F.lit("")).otherwise(snippet(text, terms(group)))
    return df.select(
        *base, "synopsis_hits", "hits", "secondaries", "screening_status", "primary_event_type",
        F.array_join("secondaries", ";").alias("secondary_event_types"),
        F.when(F.size("secondaries") > 0, F.lit("needs_author_review")).otherwise(F.lit("false")).alias("multi_event_flag"),
        evidence(lexicon.ground).alias("ground_evidence"), evidence(lexicon.cabin).alias("cabin_evidence"), "exclusion_reason",
    )
