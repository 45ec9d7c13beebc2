"""Leads, gate, hits, near-miss, coverage, pages, cache, planning and the stream."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from evidentia.operators import coverage, evidence, gate, hits, leads, near_miss, pages, planning
from evidentia.operators.identity import Brands, origin_of
from evidentia.sources import tables

CRITERIA = [{"requirement_id": "v", "label": "Supply voltage", "requested_value": "12 V DC", "critical": True}, {"requirement_id": "i", "label": "Rated current", "requested_value": "5 A", "critical": True}]
MISSION = leads.Mission("Pump ZX99-10 three stages", tuple((c["requirement_id"], c["label"], c["requested_value"]) for c in CRITERIA), origin_of("Pump ZX99-10 three stages", "Zorex", CRITERIA))
DOC = leads.Document("https://amaro.example/p/am-310", "Amaro AM-310-B pump", ("AM-310-B by Amaro",), "brand: Amaro\nmodel: AM-310-B\nSupply voltage 12 V DC. Related text.\nRelated products\nBelix BX-900-7")


@pytest.mark.parametrize("brand, reference, reason", [
    ("Amaro", "AM-310-B", None), ("AM310B", "AM-310-B", "brand_is_reference"), ("Pump relay".split()[1], "AM-310-B", "brand_is_product_noun"), ("Zorex", "AM-310-B", "origin_identity"),
    ("Amaro", "20 x 47 x 14", "reference_is_dimension_signature"), ("Amaro", "QQ-77-1", "reference_not_literal"), ("Belix", "BX-900-7", "reference_not_literal"), ("Corun", "AM-310-B", "brand_not_literal"), ("Amaro", "12 V DC", "isolated_requirement_value"),
])
def test_refusals_in_order(brand, reference, reason):
    assert leads.refusal(brand, reference, DOC, MISSION) == reason


def test_discovery_merges_and_ranks(spark):
    docs = [("m", 0, DOC.url, DOC.title, list(DOC.snippets), DOC.content, 1, [("Amaro", "AM-310-B"), ("", "x")]), ("m", 1, "https://shop.example/x", "Amaro AM310B", ["Amaro AM310B pump"], "Amaro AM310B", 2, [("Amaro", "AM310B")])]
    documents = spark.createDataFrame(docs, "mission_id string, ord int, url string, title string, snippets array<string>, content string, rank int, proposals array<struct<brand:string,reference:string>>")
    missions = spark.createDataFrame([("m", MISSION.product, "Zorex", "")], "mission_id string, product string, origin_brand string, target_brand string")
    req = spark.createDataFrame([("m", c["requirement_id"], c["label"], c["requested_value"]) for c in CRITERIA], "mission_id string, requirement_id string, label string, requested_value string")
    rows = leads.discover(documents, missions, req).collect()
    assert [(r["brand"], r["rank"]) for r in rows if r["rank"]] == [("Amaro", 1)]
    assert "malformed_proposal" in {r["reason"] for r in rows}


def test_gate(spark):
    rows = [(1, "https://a.example/p", "Code AB-1 here", "PRODUCT_EVIDENCE", ["ab-1"]), (2, "https://a.example/p", "AB1", "PRODUCT_EVIDENCE", ["ab-1"]), (3, "https://a.example/shop/p", "ab-1", "PRODUCT_EVIDENCE", ["ab-1"]), (4, "https://a.example/p", "x", "PRODUCT_EVIDENCE", [" "]), (5, "https://a.example/p", " ", "PRODUCT_DISCOVERY", []), (6, "https://a.example/p", "x", "PRODUCT_DISCOVERY", [])]
    got = {r["id"]: r["reason"] for r in gate.qualify(spark.createDataFrame(rows, "id int, url string, content string, mode string, expected array<string>").withColumn("brands", F.lit(None).cast("array<string>"))).collect()}
    assert got == {1: "ACCEPTED", 2: "REJECTED_FOR_PRODUCT_EVIDENCE", 3: "REJECTED_FOR_PRODUCT_EVIDENCE", 4: "NOT_READY_FOR_PRODUCT_EVIDENCE", 5: "REJECTED_EMPTY_CONTENT", 6: "ACCEPTED"}


def test_page_selection_is_fair(spark):
    rows = [("m", q, f"query {q}", r, f"https://s{q}.example/{r}?utm_x=1", "", "", None) for q in range(2) for r in (1, 2, 3)] + [("m", 1, "query 1", 4, "https://s0.example/1", "", "", None), ("m", 0, "query 0", 1, "https://fr.wikipedia.org/x", "", "", None)]
    df = spark.createDataFrame(rows, "mission_id string, query_ord int, query string, rank int, url string, title string, snippet string, references array<string>")
    seen = spark.createDataFrame([("m", "https://s1.example/1")], "mission_id string, url string")
    got = hits.select_pages(df, seen, 3).orderBy("position").collect()
    assert [r["canonical"] for r in got] == ["https://s0.example/1", "https://s0.example/2", "https://s1.example/2"]
    assert got[0]["queries"] == ["query 0", "query 1"]


def test_near_miss_cascade(spark):
    req = spark.createDataFrame([("m", 0, "v", "Supply voltage", "12 V"), ("m", 1, "i", "Rated current", "5 A"), ("m", 2, "c", "Category", "pump"), ("m", 3, "b", "Brand", "x")], "mission_id string, ord int, requirement_id string, label string, requested_value string")
    rows = [("1", ["a", "b"], ["Supply voltage"], []), ("2", [], ["Supply voltage"], []), ("3", [], ["Supply voltage", "Rated current"], []), ("4", ["a", "b"], [], ["Rated current"]), ("5", ["a"], [], ["Rated current"]), ("6", ["a", "b"], ["Category"], []), ("7", ["a", "b"], ["Brand"], [])]
    df = spark.createDataFrame([("m", c, p, b, n, [], False, "AB-12", "AB") for c, p, b, n in rows], "mission_id string, candidate_id string, proven_criteria array<string>, incompatible_criteria array<string>, not_proven_criteria array<string>, unverified_criteria array<string>, eligible boolean, identity string, family string")
    got = near_miss.assess(df, req)
    assert {r["candidate_id"]: r["path"] for r in got.collect()} == {"1": "ESTABLISHED", "2": "DIRECTIONAL", "3": None, "4": "INCOMPLETE", "5": None, "6": None, "7": None}
    tasks = near_miss.targeted_tasks(got)
    budget = spark.createDataFrame([("m", 2, [])], "mission_id string, budget int, seen_signatures array<string>")
    assert [r["query"] for r in near_miss.select_queries(tasks, budget).orderBy("position").collect()] == ['AB Rated current "5 A"', 'AB Supply voltage "12 V"']


def test_smallest_cover():
    sets = [("p", frozenset("ab")), ("q", frozenset("c")), ("r", frozenset("abc"))]
    assert evidence.smallest_cover(sets) == ["r"] and evidence.smallest_cover([]) == []
    many = [(str(n), frozenset({n, n + 1})) for n in range(40)]
    assert frozenset().union(*(s for u, s in many if u in evidence.smallest_cover(many))) == frozenset(range(41))


def test_brands():
    b = Brands({frozenset(["amaro"]): frozenset(["amaro.example"])}, {frozenset(["am"]): frozenset(["amaro"])})
    assert b.owns("https://www.amaro.example/x", "Amaro Group") and not b.owns("https://amaro.org/x", "Amaro") and b.owns("https://belix-electric.com/", "Belix") and not b.owns("https://belixshop.com/", "Belix")
    assert b.match("Amaro Electric", "amaro") and b.match("Amaro", "AM") and not b.match("Amaro", "xy") and not b.match("", "x")


def test_coverage(spark):
    sheet = "[PAGE page=1]\nSupply: 12 V\nSealing: both\nRange 9 - 30 V.\n[/PAGE]\n[TABLE page=1 table=1]\nrow=1 | col=1: Name | col=2: ZX99 | col=3: ZX50\nrow=2 | col=1: Power | col=2: 40 W | col=3: 70 W\n[/TABLE]\nOther 70 W"
    sheets = spark.createDataFrame([("m", "Pump ZX99", sheet)], "mission_id string, product string, sheet string")
    req = spark.createDataFrame([("m", "Supply", "12 V")], "mission_id string, label string, requested_value string")
    got = {(r["value"], r["reason"]) for r in coverage.orphans(sheets, req).collect()}
    assert got == {("40 W", "missing_spec"), ("9 - 30 V", "missing_spec"), ("both", "missing_categorical_spec")}
    assert coverage.readable("row=1 | col=1: a\x01b | col=2: c").endswith("col=2: c") and "UNREADABLE" in coverage.readable("x\x02")
    odd = spark.createDataFrame([("Operating frequency", "5 V"), ("Supply voltage", "5 V")], "label string, requested_value string")
    assert [r["review"] for r in coverage.unit_disagreements(odd).collect()] == [True, False]


def test_clean_html():
    body = "word " * 40
    got = pages.clean(f'<title>A​ b</title><script type="application/ld+json">{{"name": "N", "brand": {{"name": "B"}}}}</script><nav>menu</nav><p hidden>no</p><div>{body}</div><!-- c -->')
    assert got["title"] == "A b" and "menu" not in got["content"] and got["content"].startswith("title: A b\njsonld.name: N\njsonld.brand.name: B\n")
    assert pages.clean("<p>short</p>")["content"] == "" == pages.clean(None)["content"]


def test_page_cache(spark):
    now = F.to_timestamp(F.lit("2026-01-02 00:00:00"))
    made = spark.createDataFrame([("https://a.example/x", "t", "c", "http", [])], "url string, title string, content string, mode string, warnings array<string>")
    cache = tables.to_cache(made, F.to_timestamp(F.lit("2026-01-01 12:00:00")))
    asked = spark.createDataFrame([("https://A.example/x#y",), ("https://a.example/z",), ("mailto:x",)], "url string")
    hit, miss = tables.cached(asked, cache, now, "1 DAY")
    assert hit.count() == 1 and "page cache" in hit.first()["warnings"][0] and miss.count() == 2
    assert tables.cached(asked, cache, now, "1 HOUR")[0].count() == 0


def test_plans(spark):
    missions = spark.createDataFrame([("m", MISSION.product, "Zorex", "Amaro", [], [], None), ("n", "Pump", "", "", [], [], ["a b", "c d", "e f"])], "mission_id string, product string, origin_brand string, target_brand string, missing array<string>, previous array<string>, planned array<string>")
    req = spark.createDataFrame([(m, n, c["requirement_id"], c["label"], c["requested_value"], True) for m in "mn" for n, c in enumerate(CRITERIA)], "mission_id string, ord int, requirement_id string, label string, requested_value string, critical boolean")
    rows = planning.plan(missions, req).collect()
    own = [r["query"] for r in rows if r["mission_id"] == "m"]
    assert len(set(own)) == 3 and all(q.startswith("Amaro ") and "Zorex" not in q for q in own) and {r["strategy"] for r in rows if r["mission_id"] == "n"} == {"model"}
    assert planning.with_family("ZX99-10 pump", "Pump ZX99-10") == "ZX99 pump" and planning.semantic_value("AB12: blue", "X-AB12") == "blue"
