"""Answers of models, waves of an adaptive search, and diagnostic sections."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from evidentia.operators import payloads, waves
from evidentia.plans import diagnostics


@pytest.mark.parametrize("text, kind, want", [('{"a": 1} x', "any", {"a": 1}), ("Sure:\n```json\n[1, 2]\n```", "any", [1, 2]), ('so {broken {"queries": ["q"]}', "list", ["q"]), ('{"a": [1]} ["q"]', "list", [1]), ("nothing", "any", None), (None, "any", None), ("[1", "list", None)])
def test_first_json(text, kind, want):
    got = payloads.first_json(text, kind)
    assert (json.loads(got) if got else None) == want


def test_requirements(spark):
    good = {"product": "p", "criteria": [{"id": "a", "label": "Voltage", "requested_value": "24 V"}, {"id": "", "label": "x", "requested_value": "y"}, {"id": "a", "label": "Again", "requested_value": "1"}, {"id": "f", "label": "Frequency", "requested_value": "12 mm", "critical": False}, 7]}
    rows = [("m1", "Here: " + json.dumps(good)), ("m2", "no json"), ("m3", '{"criteria": 3}'), ("m4", "[1]")]
    out, said = payloads.requirements_of(spark.createDataFrame(rows, "mission_id string, answer string"))
    assert [(r["requirement_id"], r["critical"]) for r in out.orderBy("ord").collect()] == [("a", True), ("f", False)]
    got = {(r["mission_id"], r["path"], r["issue"], r["action"]) for r in said.collect()}
    assert {("m2", "$", "json_parse_error", "aborted"), ("m3", "criteria", "invalid_structure", "aborted"), ("m4", "$", "invalid_structure", "aborted"), ("m1", "criteria[1].id", "invalid_item", "discarded"), ("m1", "criteria[2].id", "invalid_item", "discarded"), ("m1", "criteria[3].requested_value", "unit_label_disagreement", "review"), ("m1", "criteria[4].label", "invalid_item", "discarded")} <= got


def test_audits(spark):
    criterion = {"requirement_id": "a", "requested_value": "24 V", "status": "proven", "proofs": ["24 V DC", {"url": "u", "excerpt": "e", "type": "Official"}, {"url": "u", "excerpt": "e", "type": "shop"}, 5]}
    answer = {"candidates": [{"brand": "B", "reference": "R1", "criteria": [criterion, {"requirement_id": "b"}]}, {"brand": "", "reference": "R2", "criteria": [criterion]}, 3, {"brand": "C", "reference": "R3", "criteria": []}]}
    rows = [("m", 0, "https://page", json.dumps(answer)), ("m", 1, "https://page", "?"), ("m", 2, "https://page", '{"candidates": null}')]
    out, said = payloads.audits_of(spark.createDataFrame(rows, "mission_id string, audit_ord int, page_url string, answer string"))
    (r,) = out.collect()
    assert (r["candidate_id"], r["brand"], r["observed_value"]) == ("0/0", "B", "")
    assert [tuple(p) for p in r["proofs"]] == [("https://page", "24 V DC", "web_secondaire"), ("u", "e", "web_officiel"), ("u", "e", "web_secondaire")]
    got = {(r["audit_ord"], r["path"], r["issue"]) for r in said.collect()}
    assert {(1, "$", "json_parse_error"), (2, "candidates", "invalid_structure"), (0, "candidates[2]", "invalid_item"), (0, "candidates[3].criteria", "invalid_item"), (0, "candidates[1].brand", "invalid_item"), (0, "candidates[0].criteria[1].status", "invalid_item"), (0, "candidates[0].criteria[0].proofs[0]", "invalid_item"), (0, "candidates[0].criteria[0].proofs[2].type", "invalid_item")} <= got
    bad = spark.createDataFrame([("page_audit", "secret text", "invalid_item", "discarded"), ("x", "$", "invalid_item", "review")], "stage string, path string, issue string, action string")
    assert [tuple(r) for r in payloads.sanitized(bad).collect()] == [("page_audit", "$", "invalid_item", "discarded")]


def test_provider_errors(spark):
    rows = spark.createDataFrame([(429, "X", 0, 5.0), (503, "X", 3, 90.0), (400, "APITimeoutError", 1, None), (404, "NotFound", 4, None), (None, None, 0, None)], "s int, e string, a int, asked double")
    got = rows.select(payloads.is_limited(F.col("s"), F.col("e")).alias("l"), payloads.is_temporary(F.col("s"), F.col("e")).alias("t"), payloads.retry_delay(F.col("a"), F.col("asked")).alias("d")).collect()
    assert [tuple(r) for r in got] == [(True, True, 5.0), (False, True, 20.0), (False, True, 3.0), (False, False, None), (False, False, 1.0)]


def test_waves(spark):
    leads = spark.createDataFrame([("m", "Acme", "AB-12345678", "acme", "ab12345678", 1), ("m", "Belo", "CD-1", "belo", "cd1", 2), ("m", "Zeta", "Z-9", "zeta", "z9", 3)], "mission_id string, brand string, reference string, brand_key string, reference_key string, rank int")
    sent = spark.createDataFrame([("m", "acme", "ab12345678xl", 1), ("m", "zeta", "z9", 2)], "mission_id string, brand_key string, reference_key string, n int")
    assert [(r["brand"], r["angles"], r["turn"]) for r in waves.targeted(leads, sent).orderBy("turn").collect()] == [("Belo", 0, 1), ("Acme", 1, 2)]
    missions = spark.createDataFrame([("m", "Zeta Z-9 relay", "Zeta")], "mission_id string, product string, origin_brand string")
    requirements = spark.createDataFrame([("m", "volt", "Voltage", "24 V")], "mission_id string, requirement_id string, label string, requested_value string")
    previous = spark.createDataFrame([("m", "site:a.example  AB-12345678")], "mission_id string, query string")
    assert [(r["brand"], r["sent"]) for r in waves.for_shops(leads, missions, requirements, previous, ["a.example", "b.example"]).orderBy("turn").collect()] == [("Belo", 0), ("Acme", 1)]
    schema = "mission_id string, brand_key string, reference_key string, label string"
    before = spark.createDataFrame([("m", "acme", "ab12345678", "Voltage")], schema)
    same, more = spark.createDataFrame([("m", "acme", "ab12345678x", "Voltage")], schema), spark.createDataFrame([("m", "acme", "ab12345678x", "Poles")], schema)
    assert [waves.progressed(before, x).first()["progressed"] for x in (same, more)] == [False, True]
    done = spark.createDataFrame([("a", 1, 3, 12), ("b", 4, 1, 1), ("c", 2, 11, 30), ("d", 1, 12, 0)], "mission_id string, wave int, queries int, pages int")
    assert sorted(tuple(r) for r in waves.budgets(done).collect()) == [("a", 2, 3, 12), ("c", 3, 1, 6)]
    assert spark.range(1).select(waves.names_lead(F.lit("Acme relay ab 12"), F.lit("ACME"), F.lit("AB-12")).alias("x")).first()["x"]


def test_sections(spark):
    missions = spark.createDataFrame([("m",), ("n",)], "mission_id string")
    tasks = spark.createDataFrame([("m", "s1", "P", "Voltage", "24 V", "r", 0), ("m", "s2", "P", "Poles", "3", None, 1)], "mission_id string, signature string, path string, criterion string, target string, reason string, priority int")
    skipped = spark.createDataFrame([("m", 0, "too few", "X-1", None, -1, ["Voltage"], None)], "mission_id string, ord int, reason string, identity string, family string, proven_compatible_count int, blocking_criteria array<string>, missing_criteria array<string>")
    near = diagnostics.near_miss_section(missions, tasks, tasks.limit(1), skipped)
    got = {r["mission_id"]: r["near_miss"] for r in near.collect()}
    assert (got["m"]["tasks_generated"], got["m"]["tasks_selected"], got["m"]["skipped_candidates"][0]["proven_compatible_count"]) == (2, 1, 0)
    assert (got["n"]["tasks_generated"], got["n"]["selected_tasks"]) == (0, [])
    wave = spark.createDataFrame([("m", 2, "targeted", 3, 3, 6, ["near"]), ("m", 1, "odd", -3, None, 3, None), ("n", 1, "discovery", 1, 0, 1, None)], "mission_id string, wave_index int, mode string, query_count int, logical_queries_before int, logical_queries_after int, task_types array<string>")
    shown = diagnostics.waves_section(wave)
    text = {r["mission_id"]: r["section"] for r in diagnostics.markdown(shown.join(near, "mission_id")).collect()}["m"]
    assert text.splitlines() == ["## Waves", "- Wave 1 (): 0 queries", "- Wave 2 (targeted): 3 queries", "## Targeted search", "- Voltage: 24 V", "- not followed: X-1 (too few)"]
    counters = spark.createDataFrame([("a", "not_resolved", 3, 0, 2, 0), ("b", "complete", 0, 0, 0, 0), ("c", "not_resolved", 0, 0, 0, 0), ("d", "not_resolved", 1, 0, 0, 0)], "mission_id string, status string, pages_fetched int, pages_analyzed int, pages_rejected_by_gate int, pages_not_ready_for_evidence int")
    assert [r["reason"] for r in diagnostics.unresolved_reason(counters).orderBy("mission_id").collect()] == ["PRODUCT_CONTENT_NOT_RETRIEVED", None, "NO_PAGE_RETRIEVED", None]
    leads = spark.createDataFrame([("m", 1, "A", "B", 2, ["title", "secret"]), ("m", 2, "", "B", 2, None)], "mission_id string, rank int, brand string, reference string, source_count int, fields array<string>")
    assert diagnostics.leads_section(leads).first()["candidate_leads"][0]["fields"] == ["title"]
    rejected = spark.createDataFrame([("m", 0, "A", "B", "known"), ("m", 1, "A", "C", "other")], "mission_id string, ord int, brand string, reference string, reason string")
    assert [x["reference"] for x in diagnostics.rejections_section(rejected, ("known",)).first()["rejected_candidates"]] == ["B"]
    gate = spark.createDataFrame([("m", 0, "u", "REJECTED", ["x"], None)], "mission_id string, ord int, url string, reason string, expected array<string>, matched array<string>")
    assert diagnostics.gate_section(gate).first()["gate_rejections"][0]["matched_identifiers"] == []
