"""Text scalars, classifier fixtures, the query language, structured replies."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.functions import boolquery, structured, text
from corvane.functions.lexicon import AVIATION, classify

PEOPLE = "array<struct<`9107`:string,`11330`:string>>"
# id, synopsis, narrative, status, primary, secondary, reason
CASES = [
    ("F01", "", "", "exclude_not_ground_or_cabin", "not_relevant", "", "no_ground_cabin_keyword_evidence"),
    ("F02", "", "Crew could hear a noise.", "include_ground_cabin_event", "baggage_cargo_weight_balance", "", ""),
    ("F03", "During cruise the crew felt turbulence.", "Later at the gate.", "exclude_not_ground_or_cabin", "not_relevant", "", "airborne_or_non_ground_context_only"),
    ("F04", "Pushback tug struck the towbar.", "", "include_ground_cabin_event", "pushback_towing_chocks", "", ""),
    ("F05", "", "Ground stop at the airport.", "uncertain_needs_review", "other_ground_operation", "", ""),
    ("F06", "Attendant gave passenger assist form.", "", "exclude_not_ground_or_cabin", "not_relevant", "", "passenger_assistance_not_ground_phase"),
    ("F07", "Precision Runway Monitor approach.", "", "exclude_not_ground_or_cabin", "not_relevant", "", "airborne_or_non_ground_context_only"),
    ("F08", "Wheelchair battery loaded before pushback; dispatch and maintenance notified.", "", "include_ground_cabin_event", "hazmat_mobility_device", "pushback_towing_chocks;dispatch_or_coordination", ""),
    ("F09", "Fuel truck blocked the stand.", "Wheelchair battery paperwork missing.", "include_ground_cabin_event", "ramp_ground_handling", "fueling", ""),
    ("F10", "&lt;b&gt;Jet&nbsp;bridge&lt;/b&gt; hit a wing.", "", "include_ground_cabin_event", "jetway_or_gate_infrastructure", "", ""),
    ("F11", "Details of the fuel spill are unclear.", "", "include_ground_cabin_event", "fueling", "", ""),
    ("F12", "Company memo.", "", "include_ground_cabin_event", "dispatch_or_coordination", "", ""),
    ("F13", "", "Pilot smelled smoke.", "include_ground_cabin_event", "maintenance_readiness", "", ""),
    ("F14", "Special assist request, mobility need.", "", "include_ground_cabin_event", "passenger_assistance", "", ""),
    ("F15", "Galley cart loose; catering late; mechanic called; company told.", "", "include_ground_cabin_event", "cabin_service", "maintenance_readiness", ""),
    ("F16", "Catering late at gate agent desk; dispatch called.", "", "include_ground_cabin_event", "gate_or_boarding", "cabin_service;dispatch_or_coordination", ""),
]


def test_classifier_fixtures(spark):
    rows = spark.createDataFrame([(c[0], c[1], [(c[2], None)]) for c in CASES], f"id string, syn string, people {PEOPLE}")
    syn, narrative, every = text.record_text("syn", "people")
    out = classify(rows.select("id", syn.alias("synopsis"), narrative.alias("narrative"), every.alias("all_text")), AVIATION)
    got = {r.id: r for r in out.collect()}
    for key, _, _, status, primary, secondary, reason in CASES:
        r = got[key]
        assert (r.screening_status, r.primary_event_type, r.secondary_event_types, r.exclusion_reason) == (status, primary, secondary, reason), key
        assert r.multi_event_flag == ("needs_author_review" if secondary else "false")


def test_record_text_keeps_separators(spark):
    rows = spark.createDataFrame([(None, [("", None), ("b  c", "n")]), ("s", None)], f"syn string, people {PEOPLE}")
    got = [tuple(r) for r in rows.select(*text.record_text("syn", "people")).collect()]
    assert got == [("", " b c n", "b c n"), ("s", "", "s")]


def test_scalars(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c).first()[0]
    assert pick(text.event_labels(F.lit("not_relevant"), F.lit("x; y;x;;not_relevant"))) == ["x", "y"]
    assert [pick(text.year_from_value(F.lit(v))) for v in ("2018-05", "", "18-05")] == [2018, None, None]
    assert [pick(text.in_year_window(F.lit(v), 2011, 2025)) for v in ("2018-05", "201", None, "2031")] == [True, False, False, False]
    assert [pick(text.approx_tokens(F.lit("x" * n))) for n in (0, 6, 10, 14)] == [1, 2, 2, 4]
    assert pick(text.safe_snippet(F.lit("z" * 181))) == "z" * 177 + "..."
    assert pick(text.snippet(F.lit("z" * 60 + "gate"), F.array(F.lit("gate")))) == "z" * 45 + "gate"
    assert pick(text.clean_text(F.lit("a &lt;b&gt;x&amp;y"))) == "a x&y"
    assert pick(text.coarse_label(F.lit("passenger_assistance"))) == "passenger_assistance"
    assert pick(text.format_ci(F.lit(0.5), F.lit(0.25), F.lit(0.75))) == "0.500 [0.250, 0.750]"


@pytest.mark.parametrize(("query", "expected"), [
    ("gate OR ramp", [1, 2]), ("board% AND NOT gate", [3]), ('"jet bridge"', [4]), ("NEAR((tug, towbar), 2)", [5]), ("(gate OR ramp) AND crew", [2]), ("NEAR((towbar, tug), 1)", []),
])
def test_boolean_queries(spark, query, expected):
    docs = [(1, "At the GATE."), (2, "ramp, crew"), (3, "boarding now"), (4, "a jet-bridge"), (5, "tug pulled the towbar".replace("pulled the", "pulled")), (6, None)]
    df = spark.createDataFrame(docs, "id long, t string")
    assert sorted(r.id for r in df.filter(boolquery.matches(query, "t")).collect()) == expected


@pytest.mark.parametrize("query", ["", "(a", "a )", "NEAR((a, b), x)", '""'])
def test_bad_queries(query):
    with pytest.raises(boolquery.QuerySyntaxError):
        boolquery.parse(query)


def test_query_groups_parse():
    assert all(boolquery.parse(q).op == "and" for q in boolquery.QUERY_GROUPS.values())


def test_structured_replies(spark):
    rows = spark.createDataFrame([('noise {"a":1} tail',), ("[1]",), (None,), ('{"screening_status":"uncertain_needs_review","primary_event_type":"fueling","confidence":"LOW"}',)], "r string")
    got = [r.v for r in rows.select(structured.validated(structured.extract_object("r")).alias("v")).collect()]
    assert [(v.valid_json, v.schema_valid) for v in got] == [(True, False), (False, False), (False, False), (True, True)]
    assert got[0].screening_status == "uncertain_needs_review" and got[3].confidence == "low"
    cost = spark.range(1).select(structured.token_cost(F.lit(1000), F.lit(120), *structured.model_price(F.lit("unknown")))).first()[0]
    assert abs(cost - 0.000336) < 1e-12
    content = spark.createDataFrame([("plain",), ('["a", {"text": "b"}, {"content": "c"}]',)], "c string").select(structured.message_content("c")).collect()
    assert [r[0] for r in content] == ["plain", "a\nb\nc"]


def test_prompt_is_python_json(spark):
    """The whole message equals what Python's json writes, over odd characters too."""
    texts = ["", None, 'a "b" \\u00E9 \\ /', "é€😀\x7f\x00\x1f\t\n\u2028", "x" * 100_000, "\\\\uABCD\\uABCD Ü"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", structured.prompt("t").alias("p")).orderBy("i").collect()
    for t, row in zip(texts, got, strict=True):
        system, user = row.p
        assert (system.role, system.content, user.role) == ("system", structured.SYSTEM, "user")
        want = {"task": structured.TASK, "allowed_screening_status": list(structured.STATUS_LABELS), "allowed_event_types": list(structured.EVENT_LABELS), "output_schema": structured.SHAPE, "rules": list(structured.RULES), "asrs_report": t or ""}
        assert user.content == json.dumps(want, ensure_ascii=True)
