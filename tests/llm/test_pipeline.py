"""The pipeline end to end on a small corpus with nulls, copies, repeated ids and clashing columns, against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

VOCABULARY = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_run_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("stone", "river", "light", "water", "cloud", "grass") for b in ("ing", "ed", "s", "er", "ly", "")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    base = [text(60) for _ in range(12)]
    near = base[0].split()
    near[30] = "changed"
    leak = text(25)
    rows = [(k, t, "en") for k, t in enumerate(base)] + [(50, base[1], "en"), (51, " ".join(near), "en"), (None, text(50), "en"), (None, text(50), None), (7, text(40), "en"), (60, None, "en"), (61, "123 456 !", "en"), (62, f"{text(30)} {leak} {text(30)}", "en"), (63, "", "en")]
    rows = [(*r, "s", len(r[1] or ""), 1, 2, 3) for r in rows]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, _id int, _node int, _bad int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak), (2, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = [(i, t) for i, t, *_ in rows if t and any(c.isalpha() for c in t) and i not in (50, 51, 62)]  # the least id of copies stays
    library = Tokenizer.from_file(VOCABULARY)
    ids = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4") for _, t in kept]
    want = sorted((str(i), len(x), hashlib.sha256(x.tobytes()).hexdigest()) for (i, _), x in zip(kept, ids, strict=True))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"]) for r in got) == want


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
