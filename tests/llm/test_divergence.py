"""The divergence audit against a dense brute force: every term of every pair of groups."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from evidentia.llm import divergence
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, n int"


def dense(rows, least, top):
    groups, words, docs = set(), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        groups.add((lang, source))
        words[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        mine = sorted(s for g, s in groups if g == lang)
        p_of = {}
        for s in [*mine, None]:
            count = {t: words[lang, s][t] if s is not None else sum(words[lang, x][t] for x in mine) for t in kept}
            total = sum(count.values())
            p_of[s] = {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in mine:
            pairs = [(sum(f(p_of[s][t], p_of[o][t]) for t in kept), o) for o in mine if o != s]
            terms = [(f(p_of[s][t], p_of[None][t]), t) for t in kept if words[lang, s][t] and p_of[s][t] > p_of[None][t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(found, 1) if part == "pair" or k <= top}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_audit_equals_the_dense_sums(spark, seed):
    rng = random.Random(seed)
    words = ["Wort", "été", "e-mail", "x", "naïve", "ZEBRA", "zebra", "a1b", "日本", "tie", "tye", "_"]
    rows = []
    for k in range(120):
        lang, source = rng.choice(["de", "de", "fr", None, ""]), rng.choice(["web", "web", "web", "news", None, "x\ty"])
        rows.append((None if k % 7 == 0 else k, " ".join(rng.choice(words[: 4 + k % 9]) for _ in range(rng.randrange(12))), lang, source, "t", 1))
    rows += [(1, None, "de", "mute", "t", 1), (1, "", "solo", "one", "t", 1), rows[0], rows[0], (5, "Wort " * 30_000, "fr", "long", "t", 1), (6, "--- 12 \x00", "none", "s1", "t", 1), (6, None, "none", "s2", "t", 1)]
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(3), least_docs=4, top=3)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got))
    assert set(got) == dense([r[1:4] for r in rows], 4, 3)


def test_no_rows_no_result(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_held_terms_are_handed_on(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD", 2)
    batch = pa.RecordBatch.from_pydict({"lang": ["l", "l"], "source": ["s", "s"], "text": ["a b a", "b c"]})
    rows = [r for b in divergence.term_counts(iter([batch])) for r in b.to_pylist()]
    sums = Counter()
    for r in rows:
        sums[r["term"]] += r["n"]
    assert sums == {"": 0, "a": 2, "b": 2, "c": 1}


def test_frequencies_are_exact_beyond_64_bits(spark):
    big = [(7 * 10**12 + 3, 9 * 10**12 + 1, 10**6), (0, 0, 5), (3, 10, 4)]
    frame = spark.createDataFrame(big, "c bigint, n bigint, v bigint").select(divergence.frequency(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert [r["p"] for r in frame.collect()] == [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in big]
