"""The n-gram model against a brute-force count of the same texts."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from evidentia.llm import lm
from evidentia.llm.runtime import fold


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


class Brute:
    def __init__(self, texts):
        self.pairs = Counter(p for t in texts for p in zip(["<s>", *words(t)], [*words(t), "</s>"]))
        self.c, self.kinds, self.context, self.after = Counter(), Counter(), Counter(), defaultdict(Counter)
        for (v, w), n in self.pairs.items():
            self.c[w] += n
            self.kinds[w] += 1
            self.context[v] += n
            self.after[v][min(n, 3)] += 1
        of = lambda x: [sum(n == k for n in x.values()) for k in (1, 2, 3, 4)]
        self.d, self.e = lm.discounts(of(self.pairs)), lm.discounts(of(self.kinds))
        self.total, size = sum(self.kinds.values()), len(self.c)
        self.gap = sum(self.e[min(n, 3) - 1] for n in self.kinds.values()) / self.total / (size + 1) if self.total else 1.0
        self.n = sum(self.c.values())

    def p(self, v, w):
        if not self.total:
            return 1.0
        p1 = (max(self.kinds[w] - self.e[min(self.kinds[w], 3) - 1], 0) / self.total if self.kinds[w] else 0) + self.gap
        if v not in self.context:
            return p1
        n, all_n = self.pairs[v, w], self.context[v]
        g = sum(self.d[k - 1] * m for k, m in self.after[v].items()) / all_n
        return (n - self.d[min(n, 3) - 1] if n else 0) / all_n + g * p1

    def row(self, text):
        t = [*words(text), "</s>"]
        n, v = self.n, len(self.c)
        return len(t), sum(self.c[w] > 0 for w in t), n, sum(math.log10((self.c[w] + 1) / (n + v + 1)) for w in t), sum(math.log10(self.p(a, b)) for a, b in zip(["<s>", *t], t))


def check(rows, scored):
    brute = Brute([t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2])
    got = {r["doc_id"]: r for r in scored}
    assert len(scored) == len(rows)
    for i, t in rows:
        r, want = got[i], brute.row(t)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:3]
        assert (r["base_score"], r["score"]) == pytest.approx(want[3:], rel=1e-5)


def test_against_brute_force(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    scored = lm.score_documents(documents, lm.count_model(documents, fold("doc_id", 7) != 2, shards=5)).collect()
    check(rows, scored)
    held = [r for r in scored if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_frequent_words_are_dealt_out_and_odd_texts_count(spark):
    rows = [(k, x) for k, x in enumerate([None, "", " \t\n ", "a " * 700, "The the THE b", "é x y", "z" * 1000 + " q", "a a", "a a", *("a " + f"w{k} " * 2 for k in range(60))])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", fold("doc_id", 3))
    model = lm.count_model(df, fold("doc_id", 7) != 2, shards=8)
    assert model.frequent
    check(rows, lm.score_documents(df, model).collect())


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert lm.score_documents(df, lm.count_model(df, fold("doc_id", 7) != 2)).count() == 0
