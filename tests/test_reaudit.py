"""The second pass over fetched pages: windows, excerpts, and what becomes of criteria."""

from __future__ import annotations

import pytest

from evidentia import schemas
from evidentia.operators import reaudit
from evidentia.operators.identity import Brands

BRANDS = Brands({frozenset(["acme"]): frozenset(["acme.example"])})


def test_windows_stop_at_another_product():
    text = "x " * 300 + "Acme AB-1234 coil 24 V DC, 3 poles. Acme CD-9999 coil 48 V DC" + " y" * 400
    (one,) = reaudit.identity_windows(text, ["AB-1234"], ["AB-1234"], "Acme")
    assert "24 V DC" in one and "48 V DC" not in one and len(one) <= 350 + 60
    assert "48 V DC" in reaudit.identity_windows(text.replace("CD-9999", "IEC60947"), ["AB-1234"], ["AB-1234"], "Acme")[0]
    assert "tail" not in reaudit.official_windows("AB-1234 data. Related product: tail", "AB-1234", ["AB-1234"], "Acme")[0]
    many = " ".join(["AB-1234" + " z" * 400] * 40)
    assert len(reaudit.identity_windows(many, ["AB-1234"], [], "")) == 12 and reaudit.identity_windows("", ["AB-1234"], [], "") == []


@pytest.mark.parametrize("code, is_one", [("24VDC", True), ("AC-3", True), ("IP67", True), ("3-pole", True), ("2NO", True), ("50Hz", True), ("IEC60947-4-1", True), ("DIN-35", False), ("AB-1234", False), ("BSL07", False), ("X1-24VDC", True)])
def test_technical_codes(code, is_one):
    assert reaudit.technical(code) == is_one


def test_readers():
    assert reaudit.contact_evidence("Main contacts", "3 NO", "Coil 24 V. 3 main contacts normally open; 1 auxiliary contact NO.") == "3 main contacts normally open"
    assert reaudit.contact_evidence("Main contacts", "1 NO", "1 main auxiliary contact normally open") == ""
    assert reaudit.contact_evidence("Contacts", "3 NO", "contacts à fermeture en tant que contacts principaux :\n 3").endswith("3")
    table = "AB-1 Rated operational current AC-3 9 A\nAB-2 Rated operational current AC-3 12 A"
    assert reaudit.current_evidence("Rated current", "12 A AC-3", table, "AB-2") == "Rated operational current AC-3 12 A"
    assert reaudit.current_evidence("Rated current", "9 A AC-3", table, "AB-2") == ""
    assert reaudit.usage_evidence("Usage", "motor switching / lamps", "for switching of any motor; motors: frequent switching") != ""
    assert reaudit.usage_evidence("Usage", "lamps", "lamps") == ""
    assert reaudit.asks_family("serie Product") and not reaudit.asks_family("voltage") and reaudit.names_family("LC1D") and not reaudit.names_family("24 V")


def test_pass(spark):
    req = [("m", 0, "volt", "Coil voltage", "24 V DC", True), ("m", 1, "pole", "Poles", "3 poles", True), ("m", 2, "prot", "Protection", "IP20", False)]
    proof = [("https://shop.example/p", "48 V DC", "web_secondaire")]
    rows = [("m", "c", "Acme", "AB-1234", "https://shop.example/p", 0, k, i, v, o, s, p) for k, (i, v, o, s, p) in enumerate([("volt", "24 V DC", "48 V DC", "incompatible", proof), ("pole", "3 poles", "", "not_proven", []), ("prot", "IP20", "", "not_proven", [])])]
    criteria = spark.createDataFrame(rows, schemas.CRITERIA)
    requirements = spark.createDataFrame(req, schemas.REQUIREMENTS)
    missions = spark.createDataFrame([("m", "Contactor ZZ-9", "Zeta", "", 75, False)], schemas.MISSIONS)
    pages = spark.createDataFrame([("m", 0, "https://shop.example/p", "Acme AB-1234 coil 48 V DC, 3 poles"), ("m", 1, "https://www.acme.example/ab-1234", "Acme AB-1234 contactor, coil 24 V DC, 3 poles"), ("m", 2, "https://other.example/x", "nothing IP20")], "mission_id string, page_ord int, url string, content string")
    once = reaudit.reaudit(criteria, requirements, missions, pages, BRANDS)
    first = {r["requirement_id"]: r for r in once.collect()}
    assert [(first[i]["status"], first[i]["reaudited"]) for i in ("volt", "pole", "prot")] == [("not_proven", "downgraded"), ("proven", "proven"), ("not_proven", None)]
    assert first["volt"]["proofs"] == [] and first["pole"]["proofs"][0]["url"] == "https://www.acme.example/ab-1234" and first["pole"]["proofs"][0]["type"] == "web_officiel"
    second = {r["requirement_id"]: r for r in reaudit.reaudit(once.drop("reaudited"), requirements, missions, pages, BRANDS).collect()}
    assert second["volt"]["status"] == "proven" and second["volt"]["observed_value"] == "24 V DC" and second["pole"]["reaudited"] is None
    assert [r["downgraded"] for r in reaudit.downgraded(criteria, once, requirements, missions).collect()] == [["Coil voltage"]]
    # without a page of the maker nothing changes
    shop = pages.filter("page_ord = 0")
    assert {r["reaudited"] for r in reaudit.reaudit(criteria, requirements, missions, shop, BRANDS).collect()} == {None}
    assert reaudit.reaudit(criteria.limit(0), requirements, missions, pages, BRANDS).count() == 0
