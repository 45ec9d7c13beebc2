"""Equi-joins of identities against all pairs; literal phrases of any length; coverage against a walk without its short cut."""

from __future__ import annotations

import random

from evidentia.functions import kernels as k
from evidentia.operators import coverage, leads, literal, matching, waves
from evidentia.operators.identity import page_names

KEYS = "mission_id string, brand_key string, reference_key string"


def same(a, b):
    short, long = sorted((a or "", b or ""), key=len)
    return short == long or len(short) >= 8 and short in long


def test_nested_pairs_equal_all_pairs(spark):
    rng = random.Random(2)
    code = lambda: "".join(rng.choice("ab1") for _ in range(rng.choice([0, 3, 7, 8, 9, 12, 20])))
    base = [code() for _ in range(12)]
    rows = lambda n: [(rng.choice("mn"), rng.choice(["acme", "belo", ""]), rng.choice([None, code(), rng.choice(base), code() + rng.choice(base) + code()])) for _ in range(n)]
    left, right = sorted(set(rows(60)), key=str), sorted(set(rows(60)), key=str)
    found = matching.nested_pairs(spark.createDataFrame(left, KEYS), spark.createDataFrame([(*r, n) for n, r in enumerate(right)], KEYS + ", n int"))
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    got = sorted((r["mission_id"], r["brand_key"], str(r["reference_key"]), r["n"]) for r in found.collect())
    assert got == sorted((a[0], a[1], str(a[2]), n) for a in left for n, b in enumerate(right) if a[:2] == b[:2] and same(a[2], b[2]))
    assert any(a[2] and b[2] and a[2] != b[2] and same(a[2], b[2]) for a in left for b in right)


def test_meetings_lose_no_page_that_states_a_name(spark):
    rng = random.Random(4)
    names = ["AB-12", "ab12", "x", "ＡＢ１２", "é-9", "AM 310/24-B", "straße 5", "A%42-7", "longname1234567", "9"]
    words = ["AB", "12", "ab12", "x", "xy", "é", "9", "AM", "310", "24", "B", "STRASSE", "straße", "5", "A%42", "7", "longname", "1234567", "ＡＢ"]
    pages = [(f"m{n % 2}", f"u{n}", "".join(rng.choice(words) + rng.choice([" ", "-", "/", "", "\n"]) for _ in range(rng.randrange(14)))) for n in range(120)] + [("m0", "none", None), ("m0", "empty", "")]
    given = [(m, n, [names[n]]) for m in ("m0", "m1") for n in range(len(names))] + [("m0", 99, []), ("m0", 98, None)]
    met = matching.meetings(spark.createDataFrame(given, "mission_id string, n int, names array<string>"), spark.createDataFrame(pages, "mission_id string, url string, content string"), "n")
    assert "CartesianProduct" not in met._jdf.queryExecution().executedPlan().toString()
    got = {(r["mission_id"], r["url"], r["n"]) for r in met.collect()}
    states = lambda name, text: k.identity_present(name, text) or bool(k.all_literal(name, text or ""))
    want = {(m, u, n) for m, u, text in pages for n, name in enumerate(names) if states(name, text)}
    assert want <= got and len(want) > 50
    assert len(got) < len(pages) * len(names) / 2


def test_cached_pages_and_confirmed_leads(spark):
    pages = [("m", "https://a.example/p", "t", "Amaro AM-310-24 relay"), ("m", "https://b.example/p", "t", "Belix only"), ("m", "https://a.example/shop/", "t", "Amaro AM-310-24"), ("m", "https://c.example/p", "t", "Amaro, by the way. And far from it AM-310-24"), ("n", "https://a.example/p", "t", "Amaro AM-310-24")]
    pages = spark.createDataFrame(pages, "mission_id string, url string, title string, content string")
    lead = spark.createDataFrame([("m", "Amaro", "AM-310-24", "amaro", "am31024", False), ("m", "Belix", "BX-1", "belix", "bx1", False), ("m", "Corun", "AM-310-24", "corun", "am31024", True)], "mission_id string, brand string, reference string, brand_key string, reference_key string, low_confidence boolean")
    audited = spark.createDataFrame([("m", "amaro", "am31024"), ("m", "belix", "bx1"), ("m", "corun", "am31024")], KEYS)
    done = spark.createDataFrame([("m", "https://c.example/p", "amaro", "am31024")], "mission_id string, url string, brand_key string, reference_key string")
    got = {(r["url"], tuple(x["reference_key"] for x in r["keys"])) for r in leads.cached_pages(lead, audited, pages, done).collect()}
    assert got == {("https://a.example/p", ("am31024",))}
    sure = {(r["brand"], r["url"]) for r in leads.confirmed(lead.select("mission_id", "brand", "reference"), pages).collect()}
    assert ("Amaro", "https://a.example/p") in sure and ("Amaro", "https://c.example/p") not in sure and not any(b == "Belix" for b, _ in sure)
    assert page_names("Amaro", "AM-310-24", "Amaro AM-310-24 relay") and not page_names("Amaro", "AM-310-24", "Amaro AM-310-24, a replacement for others")


def test_angles_count_nested_queries(spark):
    rows = spark.createDataFrame([("m", "acme", "ab12345678", 1), ("m", "acme", "zz", 2)], KEYS + ", rank int")
    sent = spark.createDataFrame([("m", "acme", "ab12345678xl", 1), ("m", "acme", "zzz", 5), ("m", "belo", "ab12345678", 7)], KEYS + ", n int")
    assert {r["reference_key"]: r["angles"] for r in waves.angle_counts(rows, sent).collect()} == {"ab12345678": 1, "zz": 0}


def test_literal_phrases_of_any_length(spark):
    rng = random.Random(5)
    words = ["alpha", "be", "été", "x", "9", "gamma."]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(60)]
    docs = [(None if n % 3 else n, t) for n, t in enumerate(texts)] + [(None, texts[5]), (1, None), (1, ""), (7, texts[7]), (7, texts[7])]
    phrases = ["x", "be", "ha", "ét", "alpha be", "pha b", "x 9 x", "alpha be x 9", "be x gamma. x 9", ". x", ".", "", None, "not there"]
    got = literal.occurrences(spark.createDataFrame(list(enumerate(phrases)), "n int, phrase string"), spark.createDataFrame(docs, "doc_id int, text string")).collect()
    have = sorted((r["n"], str(r["doc_id"])) for r in got)
    assert have == sorted((n, str(d)) for n, p in enumerate(phrases) if p for d, t in docs if t is not None and p in t)


def test_specifications_with_and_without_the_short_cut(monkeypatch):
    rng = random.Random(6)
    parts = ["12", "3.5", "V", "mm", "kg", "IP67", "ip", "67", "°C", "°", "to", "-", "word", ";", ".", "%", "5a", "a5", "K", "24 V DC", "K", "µg", "10..20 bar"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(10))) for _ in range(600)] + [None, ""]
    quick = [coverage.specs(t) for t in texts]
    monkeypatch.setattr(coverage, "NEAR", __import__("re").compile(""))
    assert quick == [coverage.specs(t) for t in texts] and sum(map(bool, quick)) > 100


def test_orphans_of_many_sheets_equal_a_plain_walk(spark):
    rng = random.Random(8)
    sheets = []
    for m in range(12):
        lines = [f"{rng.choice(['Voltage', 'Load', 'Weight'])}: {rng.choice(['12 V', '5 kg', '7 mm', '12 V to 24 V', 'none'])}" for _ in range(6)] + ["Sealing: 2RS", "With seals on both sides"][: m % 3]
        sheets.append((f"m{m}", "", "\n".join(lines)))
    have = [(f"m{m}", "Voltage", "12 V") for m in range(0, 12, 2)]
    got = {(r["mission_id"], r["value"], r["reason"]) for r in coverage.orphans(spark.createDataFrame(sheets, "mission_id string, product string, sheet string"), spark.createDataFrame(have, "mission_id string, label string, requested_value string")).collect()}
    want = set()
    for m, product, sheet in sheets:
        known = {k.ascii_key(s) for h in have if h[0] == m for s in coverage.distinct_specs(f"{h[1]} {h[2]}")}
        first = {}
        for f in coverage.facts(sheet, product):
            if f["kind"] == "text" and f["key"] not in known:
                first.setdefault(f["key"], f["value"])
            if f["kind"] == "word":
                want.add((m, f["value"], "missing_categorical_spec"))
        want |= {(m, v, "missing_spec") for v in first.values()}
    assert got == want and any(r == "missing_categorical_spec" for _, _, r in got)
