"""Order MinHash classes against all pairs by plain edit distance."""

from __future__ import annotations

import random
import re

import numpy as np

from evidentia.llm import omh
from evidentia.llm.words import hash_words


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def edits(a, b):
    row = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        new = np.empty_like(row)
        new[0] = i
        best = np.minimum(row[1:] + 1, row[:-1] + np.array([x != y for y in b]))
        for j, v in enumerate(best, 1):
            new[j] = min(v, new[j - 1] + 1)
        row = new
    return int(row[-1])


def brute(rows, least=0.8):
    texts = sorted({t or "" for _, t in rows})
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    toks = {t: words(t) for t in texts}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            x, y = toks[a], toks[b]
            if x and y and min(len(x), len(y)) >= least * max(len(x), len(y)) and len(set(x) & set(y)) * 3 > len(set(x)) and edits(x, y) <= (1 - least) * max(len(x), len(y)) + 1e-9:
                root[find(a)] = find(b)
    out = {}
    for i, t in rows:
        out.setdefault(find(t or ""), []).append(i)
    return {i: min(g) for g in out.values() for i in g}


def test_edit_distance_in_a_band():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.randrange(6) for _ in range(rng.randrange(0, 25))]
        b = [x for x in a if rng.random() > 0.15] + [rng.randrange(6) for _ in range(rng.randrange(3))]
        want = edits(a, b)
        for most in (0, 1, 3, 8, 40):
            assert omh.edits_within(np.array(a, np.uint64), np.array(b, np.uint64), most) == (want if want <= most else None)


def test_classes_against_all_pairs(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(40):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([12, 60, 200]))]
        rows.append(" ".join(text))
        for _ in range(rng.randrange(3)):
            rows.append(" ".join(rng.choice(vocabulary) if rng.random() < 0.03 else w for w in text))
    base = [rng.choice(vocabulary) for _ in range(80)]
    rows += [" ".join(base)] * 30 + [" ".join(base[:k] + ["x%d" % k] + base[k + 1 :]) for k in range(60)]
    rows += ["", None, " \n", "a", "a", "A", "b c", "b c d"]
    pairs = list(enumerate(rows))
    got = omh.classes(spark.createDataFrame(pairs, "doc_id bigint, text string").selectExpr("*", "1 AS node", "2 AS class_id")).collect()
    assert len(got) == len(rows)
    want = brute(pairs)
    wrong = [r for r in got if r["class_id"] != want[r["doc_id"]]]
    assert not wrong
    size = {}
    for r in got:
        size[r["class_id"]] = size.get(r["class_id"], 0) + 1
    assert all(r["class_size"] == size[r["class_id"]] for r in got)


def test_empty_table_and_null_id(spark):
    assert omh.classes(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    got = omh.classes(spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (None, "q")], "doc_id bigint, text string")).collect()
    assert sorted((str(r["doc_id"]), r["class_id"]) for r in got if r["class_size"] == 2) == [("4", 4), ("None", 4)]


def candidates_joined(texts):
    """Least id of each text's component, of all pairs that share a sketch value and are similar."""
    data = [t.encode() for t in texts]
    h, first = hash_words(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]))
    values = omh.sketch(*omh.kmers(h, first))
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in np.flatnonzero((values[:i] == values[i]).any(axis=1)):
            if root[i] != root[j] and omh.similar(h[first[i] : first[i + 1]], h[first[j] : first[j + 1]]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def test_large_groups_whose_least_id_is_not_the_centre(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(5_000)]
    change = lambda text, share: [rng.choice(vocabulary) if rng.random() < share else w for w in text]
    base = [rng.choice(vocabulary) for _ in range(200)]
    texts = [change(base, rng.choice([0.10, 0.13, 0.15])) for _ in range(300)]
    version = [rng.choice(vocabulary) for _ in range(150)]
    for _ in range(60):
        texts.append(version := change(version, 0.04))
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts += [passage + [rng.choice(vocabulary) for _ in range(60)] for _ in range(100)]
    texts = [" ".join(t) for t in [*texts, base]]
    got = {r["doc_id"]: r["class_id"] for r in omh.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    want = candidates_joined(texts)
    assert want.count(want[-1]) > 250 and want.count(want[330]) > 50
    assert [got[k] for k in range(len(texts))] == want


def test_recall_of_candidates_at_the_least_similarity():
    rng = np.random.default_rng(4)
    for share, least in ((0.20, 0.98), (0.15, 0.99)):
        base = rng.integers(0, 20_000, (1_000, 100)).astype(np.uint64) * omh.A
        copy = base.copy()
        for row in copy:
            row[rng.choice(100, int(share * 100), replace=False)] = rng.integers(1 << 40, 1 << 41, int(share * 100)).astype(np.uint64)
        first = np.arange(1_001) * 100
        a, b = (omh.sketch(*omh.kmers(x.ravel(), first)) for x in (base, copy))
        assert (a == b).any(axis=1).mean() >= least


def test_short_texts_against_all_pairs(spark):
    rng = random.Random(8)
    rows = []
    for n in list(range(4, 15)) * 3:
        text = [f"w{rng.randrange(900)}" for _ in range(n)]
        rows.append(" ".join(text))
        for at in ((n // 2,), (n // 3, 2 * n // 3)):
            rows.append(" ".join("x%d" % len(rows) if k in at else w for k, w in enumerate(text)))
        rows.append(" ".join(text[: n // 2] + text[n // 2 + 1 :]))
    pairs = list(enumerate(rows))
    got = {r["doc_id"]: r["class_id"] for r in omh.classes(spark.createDataFrame(pairs, "doc_id bigint, text string")).collect()}
    assert got == brute(pairs)


def test_one_of_each_keeps_each_text_of_a_repeated_or_missing_id(spark):
    texts = [" ".join(f"{c}{k}" for k in range(20)) for c in "abcde"]
    rows = [(1, texts[0]), (2, texts[0]), (2, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[0]), (3, texts[4]), (3, texts[4])]
    got = omh.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == sorted((str(i), t) for i, t in [rows[0], rows[2], rows[3], rows[4], rows[6]])


def test_pairs_of_texts_that_share_a_hot_passage(spark):
    rng = random.Random(23)
    word = lambda: f"w{rng.randrange(3_000)}"
    passage = [word() for _ in range(120)]
    texts = []
    for _ in range(60):
        own = [word() for _ in range(80)]
        other = list(own)
        for at in rng.sample(range(80), 36):
            other[at] = f"x{rng.randrange(10**9)}"
        texts += [passage + own, passage + other]
    texts += [passage + [word() for _ in range(80)] for _ in range(80)]
    pairs = list(enumerate(" ".join(t) for t in texts))
    got = {r["doc_id"]: r["class_id"] for r in omh.classes(spark.createDataFrame(pairs, "doc_id bigint, text string")).collect()}
    assert [got[k] for k in range(len(texts))] == [k - k % 2 if k < 120 else k for k in range(len(texts))]


def test_rarest_runs_meet_every_similar_text():
    rng = np.random.default_rng(6)
    for n in (5, 9, 10, 14, 15, 40, 200):
        most = int(0.2 * n + 1e-9)
        for words in (4, 50, 5_000):
            a = rng.integers(0, words, n).astype(np.uint64) * omh.A
            b = list(a)
            for _ in range(most):
                at = int(rng.integers(0, len(b)))
                b[at : at + 1] = [[], [omh.B + np.uint64(at)]][int(rng.integers(0, 2))]
            b = np.array(b, np.uint64)
            both, first = np.concatenate([a, b]), np.array([0, n, n + len(b)])
            counts = np.ones(omh.SLOTS, np.int64)
            for *_, key in omh.runs(both, first):
                np.add.at(counts, omh.slots_of(key), 1)
            text, key = omh.rarest_runs(both, first, counts, 0.8)
            held = {h for _, t, _, k in omh.runs(both, first) for h in k[t == 1]}
            assert held & set(key[text == 0])


def test_labelled_runs_meet_every_similar_text_in_their_rarest_part():
    rng = np.random.default_rng(16)
    for n in (5, 9, 10, 14, 15, 40, 200):
        most = int(0.2 * n + 1e-9)
        for words in (4, 50, 5_000):
            for _ in range(4):
                a = rng.integers(0, words, n).astype(np.uint64) * omh.A
                b = list(a)
                for _ in range(most):
                    at = int(rng.integers(0, len(b)))
                    b[at : at + 1] = [[], [omh.B + np.uint64(at)]][int(rng.integers(0, 2))]
                b = np.array(b, np.uint64)
                both, first = np.concatenate([a, b]), np.array([0, n, n + len(b)])
                counts = np.ones(omh.SLOTS, np.int64)
                for q in omh.GRAMS:
                    np.add.at(counts, omh.slots_of(omh.kmers(both, first, q)[0]), 1)
                x, y = omh.sought_grams(both, first, counts, 0.8), omh.held_grams(both, first, counts, 0.8)
                before = [{k: set(p[p > 0].tolist()) for k, p in zip(key[text == t].tolist(), p[text == t], strict=True)} for t, (text, key, _, p) in enumerate((x, y))]
                place = [dict(zip(key[text == t].tolist(), at[text == t].tolist(), strict=True)) for t, (text, key, at, _) in enumerate((x, y))]
                assert len(b) > n or any(not before[0][k] & before[1][k] and place[1][k] <= place[0][k] for k in before[0].keys() & before[1].keys())


def test_texts_that_share_most_of_their_words_meet_once(spark):
    rng = random.Random(31)
    line = " ".join(f"l{k}" for k in range(62))
    texts = [f"{line} " + " ".join(f"w{rng.randrange(60)}" for _ in range(38)) for _ in range(120)]
    rows = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "node bigint, root bigint, payload string")
    pairs = {(r["a"], r["b"]): r["n"] for r in omh.rare_pairs(0.8)(rows).collect()}
    hashes, first = hash_words(np.frombuffer(" ".join(texts).encode(), np.uint8), np.cumsum([0] + [len(t) + 1 for t in texts]))
    similar = {(i, j) for j in range(120) for i in range(j) if omh.similar(hashes[first[i] : first[i + 1]], hashes[first[j] : first[j + 1]])}
    assert similar <= pairs.keys()
    # each end may look the other up
    assert sum(pairs.values()) < 3 * len(pairs)


def test_runs_of_one_text_only_make_no_rows_however_many_they_are(spark, monkeypatch):
    line = " ".join(f"l{k}" for k in range(12))
    texts = spark.range(0, 3_000, 1, 4).selectExpr("id AS node", "id AS root", f"concat('{line} ', array_join(transform(sequence(1, 388), k -> concat('w', id, 'x', k)), ' ')) AS payload")
    made, cut = [], omh.cut
    monkeypatch.setattr(omh, "cut", lambda rows: made.append((out := cut(rows)).count()) or out)
    assert omh.rare_pairs(0.8)(texts).count() == 0
    assert sum(made) < 3_000 * 40
