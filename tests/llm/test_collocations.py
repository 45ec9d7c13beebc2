"""Collocations against counts phrase by phrase; bitmaps over many small shards against the same counts."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from evidentia.llm import collocations

SCHEMA = "doc_id bigint, text string, lang string, ids int, word string"


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split(r"[ \t]", p) if w] for p in re.split(r"[.,;:!?\n\x0b\x0c\r]", low)]


def slow(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for words in pieces(text):
            n["und" if lang is None else lang] += len(words)
            for k in range(1, 5):
                f[lang if lang is not None else "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        kept = []
        for p, a in counts.items():
            if len(p) < 2 or a < least:
                continue
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if any(len(q) > len(p) and b >= least and 100 * b >= 80 * a and inside(q) for q, b in counts.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            kept.append((score, a, " ".join(p), left, right))
        kept.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, rank, p, a, left, right, n[lang], score) for rank, (score, a, p, left, right) in enumerate(kept[:top], 1)]
    return sorted(out)


def texts(seed, n=150):
    rng = random.Random(seed)
    words = ["Neu", "york", "de", "la", "été", "x\x01", "x", "a\xa0b", "don't", "日本", "z"]
    rows = []
    for k in range(n):
        body = [rng.choice(words[: 5 + k % 7]) for _ in range(rng.randrange(40))]
        if k % 3:
            body[:0] = ["new", "York", "city", "hall"][: 2 + k % 3]
        joined = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", " ; "]) for w in body)
        rows.append((None if k % 5 == 0 else k, joined, rng.choice(["de", "fr", None, ""]), 1, "clash"))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_phrases_equal_brute_force(spark, seed):
    rows = texts(seed)
    rows += [rows[0], rows[0], (1, None, "de", 1, "c"), (1, "", "solo", 1, "c"), (1, "...,,,\n", "solo", 1, "c"), (2, "aa " * 20_000, "long", 1, "c"), (3, "u v. " * 7 + "u\nv", "long", 1, "c")]
    got = collocations.phrases(spark.createDataFrame(rows, SCHEMA).repartition(3), least=7, top=25)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), *((c, "bigint") for c in ("a", "l", "r", "n", "score"))]
    assert sorted(map(tuple, got.collect())) == slow([r[1:3] for r in rows], 7, 25)


def test_no_rows_no_result(spark):
    assert collocations.phrases(spark.createDataFrame([], SCHEMA)).isEmpty()
    assert collocations.phrases(spark.createDataFrame([(1, "too few", "de", 1, "c")], SCHEMA)).isEmpty()


@pytest.mark.parametrize("shard, at_once", [(60, 40), (100_000, 1_000_000)])
def test_bitmaps_over_shards_count_all_phrases(monkeypatch, shard, at_once):
    """Every word and pair taken as frequent: pairs, triples and quadruples of all shards add up to the plain counts."""
    monkeypatch.setattr(collocations, "SHARD", shard)
    monkeypatch.setattr(collocations, "AT_ONCE", at_once)
    monkeypatch.setattr(collocations, "SLICE", shard)
    rows = [(t, lang or "und") for _, t, lang, _, _ in texts(5, 60)]
    batch = pa.RecordBatch.from_pydict({"lang": [lang for _, lang in rows], "text": [t for t, _ in rows]})
    want, got, numbers = Counter(), Counter(), {}
    for text, _ in rows:
        for words in pieces(text):
            for k in range(2, 5):
                want.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    shards = [r for b in collocations.layouts(iter([batch])) for r in b.to_pylist()]
    assert len(shards) > 4 if shard == 60 else len(shards) == len({lang for _, lang in rows})
    for row in shards:
        known = [{"i": i, "id": numbers.setdefault(w, len(numbers) + 1)} for i, w in enumerate(row["words"])]
        given = pa.RecordBatch.from_pylist([row | {"n_words": len(row["words"]), "known": known}])
        word = {v: k for k, v in numbers.items()}
        for packed in (r for b in collocations.numbered(iter([given])) for r in b.to_pylist()):
            found = collocations.Shard.of(packed)
            pair, n = found.pairs()
            for p, c in zip(pair.tolist(), n.tolist(), strict=True):
                got[word[p >> 32], word[p & 0xFFFFFFFF]] += c
            for head, tail, n in found.longer(pair):
                for h, t, c in zip(head.tolist(), tail.tolist(), n.tolist(), strict=True):
                    got[tuple(word[x] for x in (h >> 32, h & 0xFFFFFFFF, t >> 32, t & 0xFFFFFFFF) if x)] += c
    assert got == want


def test_long_texts_are_cut_between_pieces():
    data = b"aaa bbb.cc ddd.eeeeeeeeeeeeeeeeeee.f"
    parts = list(collocations.slices(data, 10))
    assert b"".join(parts) == data and len(parts) > 2 and all(p.startswith(b".") for p in parts[1:])


def test_the_filter_of_pairs_holds_each_and_needs_no_join(spark, monkeypatch):
    pairs = [(k * 7_919 << 32) | k for k in range(1, 20_000)]
    frequent = spark.createDataFrame([(p,) for p in pairs], "pair bigint")
    held = collocations.filter_of_pairs(frequent).value
    assert held.passes(np.array(pairs)).all()
    assert held.passes(np.arange(100_000) << 20 | 5).mean() < 0.02
    # with a filter that lets everything through the result is the same
    rows = texts(3)
    monkeypatch.setattr(collocations, "FEWEST_BITS", 64)
    monkeypatch.setattr(collocations, "MOST_BITS", 64)
    got = collocations.phrases(spark.createDataFrame(rows, SCHEMA).repartition(3), least=7, top=25)
    assert sorted(map(tuple, got.collect())) == slow([r[1:3] for r in rows], 7, 25)
