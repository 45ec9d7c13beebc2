"""Audits of declared candidates: the whole grid, defaults, and what is discarded."""

from __future__ import annotations

import json

from evidentia.operators.declared import declared_audits

ANSWERS = {
    # two groups for the first lead, of which the first counts; an index that isn't declared; a flag; no list of criteria
    0: {"candidate_criteria": [{"candidate_index": 0, "criteria": [
        {"requirement_id": "volt", "requested_value": "24 V", "observed_value": "24 V DC", "status": "proven", "proofs": ["24 V DC", {"url": "u", "excerpt": "e", "type": "official"}, {"url": "u"}]},
        {"requirement_id": "volt", "status": "incompatible", "proofs": []}, {"requirement_id": "other", "status": "proven"}, {"requirement_id": "curr", "status": "maybe"}, "text", {"requirement_id": "poles", "requested_value": "4", "status": "not_proven"}]},
        {"candidate_index": 0, "criteria": [{"requirement_id": "curr", "status": "proven"}]}, {"candidate_index": 7, "criteria": []}, {"candidate_index": True, "criteria": []}, {"candidate_index": 1}, "x"]},
    1: {"candidate_criteria": []},
    2: {"candidates": []},
    3: "no json",
    4: {"candidate_criteria": [{"candidate_index": 1, "criteria": []}]},
}


def test_grid_defaults_and_diagnostics(spark):
    answers = spark.createDataFrame([("m", n, f"https://p/{n}", a if isinstance(a, str) else "Here: " + json.dumps(a)) for n, a in ANSWERS.items()], "mission_id string, audit_ord int, page_url string, answer string")
    declared = spark.createDataFrame([("m", n, i, b, f"R-{i}") for n in ANSWERS for i, b in enumerate(["Amaro", "Belix"])], "mission_id string, audit_ord int, candidate_index int, brand string, reference string")
    requirements = spark.createDataFrame([("m", 0, "volt", "24 V"), ("m", 1, "curr", "9 A"), ("m", 2, "poles", "3")], "mission_id string, ord int, requirement_id string, requested_value string")
    criteria, said = declared_audits(answers, declared, requirements)
    rows = criteria.collect()
    # each lead of a page whose answer has the list gets each requirement
    assert sorted({(r["audit_ord"], r["candidate_id"]) for r in rows}) == [(n, f"{n}/{i}") for n in (0, 1, 4) for i in (0, 1)] and len(rows) == 18
    told = {(r["candidate_id"], r["requirement_id"]): r for r in rows}
    volt = told["0/0", "volt"]
    assert (volt["brand"], volt["status"], volt["observed_value"], volt["requested_value"]) == ("Amaro", "proven", "24 V DC", "24 V")
    assert [tuple(p) for p in volt["proofs"]] == [("https://p/0", "24 V DC", "web_secondaire"), ("u", "e", "web_officiel")]
    assert told["0/0", "poles"]["requested_value"] == "3"
    assert all(r["status"] == "not_proven" and not r["proofs"] for key, r in told.items() if key != ("0/0", "volt"))
    at = "candidate_criteria"
    want = {
        (0, f"{at}[0].criteria[1]", "invalid_item", "discarded"), (0, f"{at}[0].criteria[2]", "invalid_item", "discarded"), (0, f"{at}[0].criteria[3].status", "invalid_item", "discarded"), (0, f"{at}[0].criteria[4]", "invalid_item", "discarded"),
        (0, f"{at}[0].criteria[5].requested_value", "invalid_item", "discarded"), *((0, f"{at}[{n}]", "invalid_item", "discarded") for n in (1, 2, 3, 4, 5)), (0, f"{at}[1]", "empty_declared_audit", "defaulted_not_proven"),
        (1, at, "empty_declared_audit", "defaulted_not_proven"), (2, at, "invalid_structure", "aborted"), (3, "$", "json_parse_error", "aborted"), (4, f"{at}[0]", "empty_declared_audit", "defaulted_not_proven"), (4, f"{at}[1].criteria", "empty_declared_audit", "defaulted_not_proven"),
    }
    assert {(r["audit_ord"], r["path"], r["issue"], r["action"]) for r in said.collect()} == want


def test_nothing_declared_nothing_audited(spark):
    answers = spark.createDataFrame([("m", 0, "p", json.dumps(ANSWERS[1]))], "mission_id string, audit_ord int, page_url string, answer string")
    none = spark.createDataFrame([], "mission_id string, audit_ord int, candidate_index int, brand string, reference string")
    requirements = spark.createDataFrame([("m", 0, "volt", "24 V")], "mission_id string, ord int, requirement_id string, requested_value string")
    assert declared_audits(answers, none, requirements)[0].isEmpty() and declared_audits(answers.limit(0), none, requirements)[1].isEmpty()
