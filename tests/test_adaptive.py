"""The adaptive loop over providers that are tables: what a query finds, what a page says, what a reader answers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from evidentia import schemas
from evidentia.operators import retries
from evidentia.operators.identity import Brands
from evidentia.plans.adaptive import Providers, research

FACTS = [("volt", "Supply voltage", "12 V DC"), ("curr", "Rated current", "5 A"), ("stages", "Number of stages", "3 stages")]
AMARO, SHOP, DAVEL, EMPTY = "https://amaro.example/items/am-310", "https://shop.example/p/am-310", "https://davel.example/en/dv-310", "https://empty.example/x"
SAYS = "{brand} {code} three stage pump.\nSupply voltage {v}. Rated current 5 A. 3 stages."
PAGES = {
    AMARO: SAYS.format(brand="Amaro", code="AM-310", v="12 V DC"),
    SHOP: "Amaro AM-310 three stage pump.\nAsk us for a price. Ships in two days.",
    DAVEL: SAYS.format(brand="Davel", code="DV-310", v="36 V DC"),
}
BRANDS = Brands({frozenset([b]): frozenset([f"{b}.example"]) for b in ("amaro", "davel")})


def answer(url, brand, code, values):
    criteria = [{"requirement_id": i, "requested_value": w, "observed_value": o, "status": "proven" if o else "not_proven", "proofs": [{"url": url, "excerpt": f"{label} {o}" if i != "stages" else o, "type": "official"}] if o else []} for (i, label, w), o in zip(FACTS, values, strict=True)]
    return json.dumps({"candidates": [{"brand": brand, "reference": code, "criteria": criteria}]})


ANSWERS = {
    AMARO: "Found: " + answer(AMARO, "Amaro", "AM-310", ("12 V DC", "5 A", "3 stages")),
    SHOP: answer(SHOP, "Amaro", "AM-310", ("", "", "")),
    DAVEL: answer(DAVEL, "Davel", "DV-310", ("36 V DC", "5 A", "3 stages")),
}


class Tables:
    """Providers over tables; keeps what they were asked."""

    def __init__(self, spark, found, broken=()):
        self.asked, self.read, self.broken = [], [], set(broken)
        self.found = spark.createDataFrame(found, "mission_id string, needle string, rank int, url string, title string, snippet string")
        self.texts = spark.createDataFrame(list(PAGES.items()), "url string, content string")
        self.spark = spark

    def search(self, queries):
        rows = queries.collect()
        self.asked.append(sorted((r["mission_id"], r["query_ord"], r["query"]) for r in rows))
        return queries.join(self.found, "mission_id").filter(F.contains(F.lower("query"), F.col("needle"))).select("mission_id", "query_ord", "query", "rank", "url", "title", "snippet")

    def fetch(self, urls):
        return urls.join(self.texts, "url", "left").select("mission_id", "url", F.lit("").alias("title"), "content")

    def audit(self, pages):
        rows = pages.collect()
        self.read += [(r["page_url"], r["mode"], tuple(map(tuple, r["declared"] or ()))) for r in rows]
        told = {r["page_url"]: ANSWERS.get(r["page_url"], "nothing") for r in rows}
        for url in self.broken & told.keys():
            told[url] = "{ broken"
            self.broken.remove(url)
        return pages.join(self.spark.createDataFrame([*told.items(), ("", "")], "page_url string, answer string"), "page_url").select("mission_id", "audit_ord", "page_url", "answer")


def tables_of(spark, missions):
    rows = spark.createDataFrame([(m, "Three stage pump", "", target, 75, False) for m, target in missions], schemas.MISSIONS)
    requirements = spark.createDataFrame([(m, n, i, label, value, True) for m, _ in missions for n, (i, label, value) in enumerate(FACTS)], schemas.REQUIREMENTS)
    return rows, requirements


MISSIONS = [("m", ""), ("n", ""), ("w", "Amaro"), ("h", "")]
FOUND = [
    ("m", "fiche produit", 1, DAVEL, "Davel DV-310", "three stage pump"), ("m", "fiche produit", 2, EMPTY, "Three stage pump", ""), ("m", "variante1", 1, AMARO, "Amaro three stage pump", "supply voltage 12 V DC"),
    ("n", "fiche produit", 1, EMPTY, "Three stage pump", ""),
    ("w", "fiche produit", 1, EMPTY, "Amaro AM-310 pump relay", "three stage pump"), ("w", "am-310", 1, SHOP, "AM-310 at the shop", "Amaro AM-310"), ("w", "variante1", 1, AMARO, "Amaro three stage pump", "12 V DC 5 A 3 stages supply voltage"),
    ("h", "fiche produit", 1, EMPTY, "Davel DV-310 pump", ""), ("h", "fiche produit", 2, "https://pump.example/list-of", "A pump", ""),
]


def hint(hits):
    """For h alone: a lead that the first hit names, and one that the second doesn't."""
    rows = hits.filter("mission_id = 'h'")
    return rows.select("mission_id", "hit_ord", F.when(F.col("hit_ord") == 0, "Davel").otherwise("Amaro").alias("brand"), F.lit("DV-310").alias("reference"))


@pytest.fixture(scope="module")
def ran(spark):
    given = Tables(spark, FOUND, (DAVEL,))
    out = research(*tables_of(spark, MISSIONS), Providers(given.search, given.fetch, given.audit, hint), BRANDS, ("parts.example",))
    tables = {f: [r.asDict() for r in getattr(out, f).collect()] for f in ("evaluations", "results", "pages", "verdicts", "diagnostics", "waves", "queries", "leads", "refused")}
    return given, {f: {m: [r for r in rows if r["mission_id"] == m] for m, _ in MISSIONS} for f, rows in tables.items()}


def result(out, mission):
    return tuple(out["results"][mission][0][c] for c in ("status", "final_state", "stop_reason"))


def test_leads_near_misses_and_shops_are_asked_for(ran):
    given, out = ran
    assert result(out, "m") == ("complete", "candidate_selected", "PROVEN_EQUIVALENT")
    assert {r["reference"]: (r["score"], r["complete"]) for r in out["evaluations"]["m"]} == {"DV-310": (66, False), "AM-310": (100, True)}
    sent = sorted(out["queries"]["m"], key=lambda r: (r["wave"], r["query_ord"]))
    assert {r["kind"] for r in sent if r["wave"] == 1} == {"general"}
    second = [(r["kind"], r["query"]) for r in sent if r["wave"] == 2]
    assert second[0][0] == "near_miss" and "12 V DC" in second[0][1]
    assert set(second[1:]) == {("lead", "Davel DV-310 fiche technique"), ("shop", "site:parts.example DV-310")}
    assert [k["reference_key"] for r in sent if r["kind"] == "lead" for k in r["keys"]][:1] == ["dv310"]
    modes = {r["wave"]: r["mode"] for r in out["waves"]["m"]}
    assert [modes[n] for n in (1, 2, 3)] == ["discovery", "targeted", "discovery"]
    # the broken answer was asked for once more
    assert [u for u, _, _ in given.read].count(DAVEL) >= 2
    assert ("json_parse_error", "retried") in {(r["issue"], r["action"]) for r in out["diagnostics"]["m"]}


def test_budgets_hold_and_no_query_goes_out_twice(ran):
    given, out = ran
    for mission, _ in MISSIONS:
        sent = [r["query"] for r in out["queries"][mission]]
        assert len(set(sent)) == len(sent) <= 12
        assert all(r["sent"] <= 3 and r["queries"] <= 12 and r["pages"] <= 36 for r in out["waves"][mission])
        angles = [k["reference_key"] for r in out["queries"][mission] if r["kind"] == "lead" for k in r["keys"]]
        assert all(angles.count(x) <= 2 for x in angles)


def test_a_mission_without_readable_pages(ran):
    _, out = ran
    assert result(out, "n") == ("not_resolved", "no_candidate_discovered", "QUERY_BUDGET_EXHAUSTED")
    assert {r["accepted"] for r in out["verdicts"]["n"]} == {False} and not out["leads"]["n"]


def test_a_mission_that_needs_a_lead_is_solved_in_wave_3(ran):
    """A hit names a lead that no page was opened for; its first page proves nothing; the next discovery reads the maker's page."""
    given, out = ran
    assert [r["mode"] for r in sorted(out["waves"]["w"], key=lambda r: r["wave"])][:3] == ["discovery", "targeted", "discovery"]
    assert result(out, "w") == ("complete", "candidate_selected", "PROVEN_EQUIVALENT")
    assert {r["url"]: r["wave"] for r in out["pages"]["w"]} == {EMPTY: 1, SHOP: 2, AMARO: 3}
    verdicts = {r["url"]: (r["mode"], tuple(r["expected"] or ())) for r in out["verdicts"]["w"]}
    assert verdicts[SHOP] == ("PRODUCT_EVIDENCE", ("AM-310",)) and verdicts[EMPTY][0] == "PRODUCT_DISCOVERY"
    assert (SHOP, "targeted", (("Amaro", "AM-310"),)) in given.read
    assert [(r["brand"], r["reference"], r["rank"]) for r in out["leads"]["w"]] == [("Amaro", "AM-310", 1)]


def test_hints_hold_only_on_the_hit_that_they_cite(ran):
    _, out = ran
    assert ("DV-310", "reference_not_literal") in {(r["reference"], r["reason"]) for r in out["refused"]["h"]}
    assert [(r["brand"], r["reference"]) for r in out["leads"]["h"]] == [("Davel", "DV-310")]
    assert result(out, "h")[1] == "candidates_discovered_but_not_audited"


def test_no_missions_no_rows(spark):
    given = Tables(spark, FOUND)
    none = research(*(t.limit(0) for t in tables_of(spark, MISSIONS)), Providers(given.search, given.fetch, given.audit), BRANDS)
    assert all(x.isEmpty() for x in (none.results, none.evaluations, none.pages, none.waves, none.queries, none.leads, none.verdicts, none.diagnostics, none.refused))


@pytest.mark.parametrize("last, want", [((True, 200, None, None), ("succeeded", 3, None)), ((False, 404, "NotFound", None), ("failed", 3, None)), ((False, 503, None, None), ("retry", 3, 8.0)), ((False, 429, "RateLimit", 30.0), ("retry", 3, 30.0))])
def test_outcomes_of_attempts(spark, last, want):
    import datetime as dt

    at = lambda n: dt.datetime(2026, 1, 1, 0, 0, n)
    rows = [("r", at(0), False, 500, None, None), ("r", at(2), False, None, "APITimeoutError", 5.0), ("r", at(9), *last), ("s", at(0), False, 401, None, None), ("s", at(1), True, 200, None, None)]
    rows += [("x", at(n), False, 503, None, None) for n in range(7)]
    events = spark.createDataFrame(rows, "id string, at timestamp, ok boolean, status int, kind string, asked double")
    got = {r["id"]: r for r in retries.outcomes(events, "id").collect()}
    assert (got["r"]["state"], got["r"]["attempts"], got["r"]["delay"]) == want and got["r"]["waited"] == 6.0
    assert (got["s"]["state"], got["s"]["attempts"]) == ("failed", 1)
    assert (got["x"]["state"], got["x"]["attempts"], got["x"]["waited"]) == ("exhausted", 5, 32.0)
    asked = spark.createDataFrame([("r",), ("s",), ("new",)], "id string")
    due = {r["id"] for r in retries.due(asked, retries.outcomes(events, "id"), F.lit(at(20)), "id").collect()}
    assert due == {"new"} | ({"r"} if want[2] == 8.0 else set())
