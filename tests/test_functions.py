"""Scalar functions and URL predicates, table by table, with newly written rows."""

from __future__ import annotations

import time

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidentia.functions import kernels as k
from evidentia.functions import quantity, urls


@pytest.mark.parametrize("requested, observed, expected", [
    ("12 V DC", "Supply 12 V DC", True), ("12 V DC", "9 - 30 V DC", True), ("12 V DC", "36 V DC", False), ("12 V DC", "9...30 V AC", False),
    ("12 V DC", "12 V", None), ("12 V", "12 A", None), ("no number", "12 V", None), ("12 V DC", "DC: 12 V", True), ("5 A", "4,5 to 5,5 A", True), ("24 VDC", "24 V cc", True),
    ("12 V DC", "36 V DC and 12 V DC", True), ("12 V DC", "", None),
])
def test_points_and_ranges(requested, observed, expected):
    assert quantity.within(requested, observed) is expected


@pytest.mark.parametrize("label, requested, observed, expected", [("bore", "20 mm", "20 x 47 x 14 mm", True), ("Width", "15 mm", "20x47x14 mm", False), ("outer diameter", "47 mm", "20×47×14 mm", True), ("mass", "20 mm", "20 x 47 x 14 mm", None), ("bore", "20 cm", "20 x 47 x 14 mm", None)])
def test_dimension_axes(label, requested, observed, expected):
    assert quantity.triplet_matches(label, requested, observed) is expected


def test_many_quantities_take_linear_time():
    text = " ".join(f"{n} - {n + 1} V AC" for n in range(4000)) + " " + " ".join(f"{n} V AC" for n in range(4000))
    began = time.time()
    assert quantity.within("9999 V DC", text) is False
    assert time.time() - began < 1.5


@given(st.integers(1, 10**6), st.integers(0, 10**4))
def test_a_point_lies_in_its_own_range(low, width):
    assert quantity.within(f"{low} V", f"{low} - {low + width} V") is True
    assert quantity.within(f"{low + width + 1} V", f"{low} - {low + width} V") is False


@pytest.mark.parametrize("excerpt, content, span", [("a  b", "x a b y", "a b"), ("modele", "le modèle bleu", "modèle"), ("modele", "modèle, modéle", ""), ("L'eau", "L’eau", ""), ("", "x", ""), ("12 V", "12\nV", "12\nV")])
def test_exact_spans(excerpt, content, span):
    assert k.exact_span(excerpt, content) == span


@pytest.mark.parametrize("ean, ok", [("4006381333931", True), ("4006381333932", False), ("96385074", True), ("036000291452", True), ("12", False), ("40063813339x1", False)])
def test_check_digits(ean, ok):
    assert k.valid_ean(ean) is ok


def test_folds():
    assert k.quotation("L’Été – œuf­s  x") == "l'ete - œufs x" and k.identity_key("AB-12%2F3") == "ab123" and k.phrase_key("Tension_de  BOBINE") == "tension de bobine"
    assert k.decode_ladder("é".encode()) == "é" and k.decode_ladder(b"\xe9") == "é" and k.decode_ladder(b"\x81") == "�"


URLS = ["https://A.example/x?utm_source=1&b=2#f", "http://shop.example/shop/x", "https://b.example/quality-switch", "https://b.example/p?q=1", "https://fr.wikipedia.org/wiki/X", "https://b.example/x.step", "https://b.example/x.pdf", "https://jobs.b.example/", "https://b.example/blog/x", "https://w.b.co.uk/s?k=1", "https://b.example/search-results", None, "::bad"]


def test_url_columns_agree_with_their_kernels(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    c = F.col("url")
    got = df.select("url", urls.is_list_page(c).alias("l"), urls.is_usable(c).alias("u"), urls.is_readable(c).alias("r"), urls.is_off_topic(c).alias("o"), urls.domain_of(c).alias("d"), urls.canonical_url("url").alias("c")).collect()
    rows = {r["url"]: r for r in got}
    assert [rows[u]["l"] for u in URLS] == [urls.is_list(u) if u else False for u in URLS] or [bool(rows[u]["l"]) for u in URLS] == [bool(urls.is_list(u)) for u in URLS]
    assert {u for u in URLS if not rows[u]["u"]} == {"https://b.example/x.step"} and not rows["https://b.example/x.pdf"]["r"]
    assert {u for u in URLS if rows[u]["o"]} == {"https://fr.wikipedia.org/wiki/X", "https://jobs.b.example/", "https://b.example/blog/x"}
    assert rows["https://w.b.co.uk/s?k=1"]["d"] == "b.co.uk" and rows[URLS[0]]["c"] == "https://a.example/x?b=2"
