"""Tables of PDFs, the rungs of fetching, completed requirements, and plain results."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import coverage, requirements
from evidentia.plans import alternatives
from evidentia.sources import fetching, pdf_tables


def test_tables_read_back(spark):
    cells = [("a.pdf", 1, t, r, c, f"{'Bore' if c == 1 else f'{r}{c} mm'}| x\ny" if (t, r, c) == (0, 1, 1) else f"v{t}{r}{c}", 10.0 * c, 10.0 * c + 5.5, [0.0, 1.25, 100.0, 50.0]) for t in (0, 1) for r in (1, 2) for c in (1, 2)]
    rows = spark.createDataFrame(cells + [("b.pdf", 2, 0, 1, 1, None, None, 3.0, None)], "path string, page int, table_ord int, row int, col int, text string, x1 double, x2 double, bbox array<double>")
    got = {(r["path"], r["table"]): r["block"].split("\n") for r in pdf_tables.tables(rows).collect()}
    assert got["a.pdf", 1] == ["[TABLE page=1 table=1]", "[GEOMETRY bbox=0,1.25,100,50 columns=10:15.5;20:25.5]", r"row=1 | col=1: Bore\| x y | col=2: v012", "row=2 | col=1: v021 | col=2: v022", "[/TABLE]"]
    assert got["b.pdf", 1] == ["[TABLE page=2 table=1]", "row=1 | col=1: ", "[/TABLE]"] and len(got) == 3
    pages = spark.createDataFrame([("a.pdf", 2, "two"), ("a.pdf", 1, " one ")] + [("c.pdf", n, "x") for n in range(40)], "path string, page int, text string")
    texts = {r["path"]: r["text"] for r in pdf_tables.documents(pages, rows.withColumn("path", F.when(F.col("path") == "b.pdf", "c.pdf").otherwise(F.col("path")))).collect()}
    assert texts["a.pdf"].startswith("[PAGE page=1]\none\n[/PAGE]\n\n[PAGE page=2]") and texts["a.pdf"].count("[TABLE") == 2 and "[TABLE" not in texts["c.pdf"]
    back = spark.createDataFrame([(got["a.pdf", 1][1],), ("[GEOMETRY bbox=0,x,1,2 columns=1:2]",), ("none",)], "b string").select(requirements.geometry(F.col("b")).alias("g")).collect()
    assert back[0]["g"]["columns"] == [[10.0, 15.5], [20.0, 25.5]] and back[1]["g"] is None and back[2]["g"] is None


def test_rungs(spark):
    schema = "url string, ord int, mode string, outcome string, status int, content_type string, html_length int, text_length int, error_type string, error_message string, duration_ms int"
    rows = [("https://a.example/1", 0, "http", "exception", None, None, 0, 0, "Timeout", "took\n too long", 5), ("https://b.example/1", 0, "http", "unusable_status", 403, "", 0, 0, None, None, 7), ("https://b.example/1", 1, "stealth", "empty_content", 200, "text/html", 90, 3, None, None, 8), ("https://c.example/1", 0, "http", "success", 200, "", 900, 800, None, None, 1), ("https://d.example/1", 0, "http", "unusable_status", 429, "x", 0, 0, None, None, 1), ("https://d.example/1", 1, "stealth", "invalid_status", None, "", 0, 0, None, None, 1), ("https://d.example/2", 0, "camoufox", "unusable_status", 403, "", 0, 0, None, None, 1), ("https://e.example/1", 0, "stealth", "unusable_status", 404, "", 0, 0, None, None, 1)]
    attempts = spark.createDataFrame(rows, schema)
    said = {(r["url"], r["ord"]): r["description"] for r in fetching.described(attempts).collect()}
    assert said["https://a.example/1", 0] == "http=exception [Timeout: took too long] in 5 ms" and said["https://b.example/1", 0] == "http=unusable_status [HTTP 403, type unknown] in 7 ms"
    assert said["https://b.example/1", 1] == "stealth=empty_content [HTTP 200, 90 characters of HTML, 3 of use] in 8 ms" and said["https://d.example/1", 1] == "stealth=invalid_status [unreadable HTTP status] in 1 ms"
    asked = spark.createDataFrame([(u,) for u in {r[0] for r in rows} | {"https://n.example/x", "https://n.example/A.PDF?x=1", "ftp://n.example/y"}], "url string")
    got = {r["url"]: r["rung"] for r in fetching.next_rungs(asked, attempts).collect()}
    assert got == {"https://a.example/1": "stealth", "https://b.example/1": "camoufox", "https://n.example/x": "http", "https://n.example/A.PDF?x=1": "pdf"}
    assert "camoufox" not in {r["rung"] for r in fetching.next_rungs(asked, attempts, third=False).collect()}
    payload = spark.createDataFrame([('{"unresponsive_engines": [["Bing", "too  many requests"], ["x"]]}',), ("{}",), (None,)], "p string")
    assert [r["r"] for r in payload.select(fetching.unresponsive_reason(F.col("p"), F.lit("bing")).alias("r")).collect()] == ["too many requests", "", ""]


def test_supplement(spark):
    schema = "mission_id string, ord int, requirement_id string, label string, requested_value string, critical boolean"
    own = spark.createDataFrame([("m", 0, "volt", "Voltage", "24 V", True)], schema)
    sheet = "Voltage: 24 V. Storage temperature: 85 °C. Current: 9 A"
    sheets = spark.createDataFrame([("m", "", sheet)], "mission_id string, product string, sheet string")
    left = coverage.orphans(sheets, own)
    add = [(0, "temp", "Storage temperature", "85 °C", sheet, None), (1, "volt", "Current", "9 A", sheet, None), (2, "again", "Temperature", "85 °C", sheet, None), (3, "none", "Current", "7 A", sheet, None), (4, "amp", "Weight", "9 A", sheet, None)]
    extra = spark.createDataFrame([("m", o, i, lab, v, True, e, p, None, None) for o, i, lab, v, e, p in add], schema.replace("ord int", "ord int") + ", evidence_excerpt string, page int, table int, col int")
    got = [(r["ord"], r["requirement_id"]) for r in requirements.supplemented(own, extra, left, sheets, located=True).orderBy("ord").collect()]
    assert got == [(0, "volt"), (1, "temp")]
    assert requirements.supplemented(own, extra.limit(0), left, sheets).count() == 1
    assert "85 °C" in requirements.orphan_text(left).first()["text"]
    paths = spark.createDataFrame([("m", "x.PDF"), ("n", "x.pdf")], "mission_id string, source_path string")
    assert [r["mission_id"] for r in requirements.needs_pictures(left, paths).collect()] == ["m"]
    assert requirements.described_product("AB-12", "Maker\nAB-12\nPower relay with coil\nVoltage: 2 V") == "Power relay with coil AB-12"
    assert requirements.described_product("Relay AB-12", "AB-12\nPower relay") == "Relay AB-12" and requirements.described_product("AB-12", "AB-12\nRELAY COIL") == "AB-12"


def test_best_alternative(spark):
    source = lambda kind: {"type": kind}
    rows = [("r", 0, "complete", "A", 10, [], [], [source("web_secondaire")]), ("r", 1, "avec_adaptation", "B", 90, ["gap"], [], [source("web_officiel")]), ("r", 2, "complete", "C", 10, [], [], [source("web_officiel")]), ("r", 3, "complete", "", 99, [], [], [source("web_officiel")]), ("s", 0, "avec_adaptation", "D", 60, ["gap"], [], [source("x")]), ("s", 1, "rejected", "E", 99, [], [], [source("x")])]
    results = spark.createDataFrame(rows, "request_id string, ord int, status string, alternative string, relevance int, deviations array<string>, limits array<string>, sources array<struct<type:string>>")
    assert [r["alternative"] for r in alternatives.best(results).collect()] == ["C"]
    assert sorted(r["alternative"] for r in alternatives.best(results, 50).collect()) == ["C", "D"]
