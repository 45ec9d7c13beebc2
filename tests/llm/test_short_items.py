"""Decontamination of short items: every substitution that leaves SHARE of an item's words."""

from __future__ import annotations

import math
from itertools import combinations

from evidentia.llm import decontaminate


def test_all_substitutions_of_short_items(spark):
    items = {n: [f"w{n}x{k}" for k in range(n)] for n in range(2, 13)}
    docs, want = [], set()
    for n, words in items.items():
        for d in range(n - math.ceil(n * decontaminate.SHARE) + 1):
            for gone in combinations(range(n), d):
                want.add((len(docs), n))
                docs.append((len(docs), " ".join(["before", *("other" if k in gone else w for k, w in enumerate(words)), "after"])))
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id bigint, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
