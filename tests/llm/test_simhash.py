"""SimHash against brute force: fingerprints word by word, links by all pairs, the ring's keys on pairs of every distance."""

from __future__ import annotations

import random

import pytest
import xxhash
from evidentia.llm import simhash

M64 = (1 << 64) - 1


def slow_fingerprint(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """The least index in each one's component, by all pairs."""
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, x in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(prints))]


def test_classes_equal_brute_force(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["Alpha", "beta", "été", "x"]) + str(rng.randrange(300))
    base = [[word() for _ in range(400)] for _ in range(6)]
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "ONE", "two words", "a b c d", "A  b\tc\nd", "word " * 30_000, "nb\xa0sp x\x1cy"]
    for b in base:
        for k in range(12):
            t = list(b)
            for _ in range(k // 2):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
    texts += [texts[10]] * 3
    rows = [(k, t, "z", 1) for k, t in enumerate(texts)]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.classes(spark.createDataFrame(rows, "doc_id bigint, text string, node string, root int").repartition(3)).collect()}
    prints = [slow_fingerprint(t) for t in texts]
    assert got == {k: (f"{p:016x}", c) for k, (p, c) in enumerate(zip(prints, slow_components(prints), strict=True))}
    assert 1 < len({c for _, c in got.values()}) < len(texts)


def test_null_and_repeated_ids_and_no_rows(spark):
    rows = [(None, "p q r s t"), (None, "p q r s t"), (7, "u v w"), (7, "k l m n"), (None, "u v w")]
    got = sorted(map(tuple, simhash.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(None, None), (None, None), (7, 7), (7, 7), (None, 7)], key=str)
    assert simhash.classes(spark.createDataFrame([], "doc_id bigint, text string")).isEmpty()


def flipped(rng, x, n):
    for b in rng.sample(range(64), n):
        x ^= 1 << b
    return x


@pytest.mark.parametrize("level", simhash.LEVELS)
def test_every_pair_within_the_budget_shares_a_key(level):
    rng = random.Random(level)
    masks = simhash.masks(level)
    assert len(masks) == {1: 4, 2: 22, 3: 140}[level]
    turn = lambda x, t: (x << 4 * t | x >> (64 - 4 * t)) & M64 if t else x
    ends = [(3, 0), (7, 1), (11, 2), (15, 3), (16, 4)]
    for k in range(600):
        near = rng.sample(range(20), 1 + k % 4) if k % 3 else rng.sample(range(64), 4)
        x = sum(1 << (b + k) % 64 for b in near)
        chains = [t for t in range(16) if all((turn(x, t) >> (64 - 4 * s)).bit_count() <= b for s, b in ends)]
        assert chains
        assert all(any(not turn(x, t) & m for m in masks) for t in chains)


def test_groups_of_many_fingerprints_take_every_level(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", 2)
    rng = random.Random(9)
    bases = [rng.getrandbits(64) for _ in range(4)]
    prints = {flipped(rng, b, rng.randrange(12)) for b in bases for _ in range(150)} | {flipped(rng, bases[0], 40) for _ in range(50)}
    # a chain whose ends are far apart
    x = rng.getrandbits(64)
    for _ in range(12):
        x = flipped(rng, x, 4)
        prints.add(x)
    prints = sorted(prints)
    nodes = spark.createDataFrame([(simhash.signed(p),) for p in prints], "node bigint")
    roots = {r["node"]: r["root"] for r in simhash.linked(nodes).collect()}
    want = slow_components(prints)
    of = [roots.get(simhash.signed(p), simhash.signed(p)) for p in prints]
    assert len(set(zip(of, want, strict=True))) == len(set(of)) == len(set(want))


def test_a_pair_is_made_once_however_many_buckets_it_shares(spark):
    x = random.Random(4).getrandbits(64)
    prints = [x ^ (1 << b) for b in range(0, 64, 4)]
    nodes = spark.createDataFrame([(simhash.signed(p), simhash.signed(p), t) for p in prints for t in range(16)], "node bigint, root bigint, turn int")
    for level in simhash.LEVELS:
        rows = simhash.shared(simhash.keys(nodes, level))
        a, b = simhash.side(rows, "a"), simhash.side(rows, "b")
        assert simhash.met(a, b, simhash.F.col("node_a") < simhash.F.col("node_b"), level).count() == 16 * 15 // 2


def test_small_buckets_are_looked_up_once(spark, monkeypatch):
    rng, rows, shared = random.Random(6), [], simhash.shared
    monkeypatch.setattr(simhash, "shared", lambda r: rows.append((out := shared(r)).count()) or out)
    top = rng.getrandbits(32) << 32
    prints = [top | rng.getrandbits(32) for _ in range(20)] + [top, top | 1]
    roots = simhash.linked(spark.createDataFrame([(simhash.signed(p),) for p in prints], "node bigint")).collect()
    assert {r["node"] for r in roots} >= {simhash.signed(top), simhash.signed(top | 1)}
    assert rows[0] >= 22 and not any(rows[1:])
