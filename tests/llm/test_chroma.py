"""Fingerprints of rendered recordings: shifts, noise, and classes against all pairs."""

from __future__ import annotations

import io
import wave

import numpy as np

from evidentia.llm import chroma


def wav(x, rate=chroma.RATE, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.repeat((x * 30_000).astype("<i2"), channels).tobytes())
    return out.getvalue()


def test_a_shifted_part_aligns_at_its_offset():
    rng = np.random.default_rng(1)
    a = chroma.decode_wav(chroma.render(rng.normal(size=64).tolist()))
    whole, part = chroma.fingerprint(a), chroma.fingerprint(a[6 * chroma.HOP :])
    assert chroma.align(whole, part)[::2] == (6, 0.0)
    assert chroma.align(part, whole)[0] == -6
    stereo = chroma.fingerprint(chroma.decode_wav(wav(np.repeat(a, 2), 2 * chroma.RATE, 2)))
    assert chroma.align(whole, stereo)[2] < 0.05
    other = chroma.fingerprint(chroma.decode_wav(chroma.render(rng.normal(size=64).tolist())))
    assert chroma.align(whole, other)[2] > chroma.ERRORS


def test_odd_media():
    for media in (None, b"", b"RIFF", wav(np.zeros(10)), wav(np.zeros(100_000))[:60]):
        assert len(chroma.fingerprint(chroma.decode_wav(media))) == 0
    assert len(chroma.fingerprint(chroma.decode_wav(wav(np.zeros(20_000))))) > 0
    assert chroma.render(None) is None and chroma.render([]) is None


def test_classes_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = [rng.normal(size=64) for _ in range(12)]
    vectors = base + [base[k % 4] + rng.normal(size=64) * 0.06 for k in range(24)] + [base[0]] * 5
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    df = chroma.rendered(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), "vec_id", "embedding")
    df = df.union(spark.createDataFrame([(90, None), (91, b"x"), (92, wav(np.zeros(9)))], df.schema)).selectExpr("*", "1 AS id", "2 AS node")
    got = {r["vec_id"]: r for r in chroma.classes(df, "vec_id", "media").collect()}
    prints = [chroma.fingerprint(chroma.decode_wav(chroma.render(v.tolist()))) for v in vectors]
    root = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            _, size, errors = chroma.align(prints[j], prints[i])
            if errors <= chroma.ERRORS and 2 * size >= len(prints[i]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert [got[k]["class_id"] for k in range(len(prints))] == root
    assert {got[k]["class_id"] for k in (90, 91, 92)} == {90} and got[90]["n_windows"] == 0
    assert chroma.classes(spark.createDataFrame([], "vec_id bigint, media binary"), "vec_id", "media").count() == 0


def test_sustained_tones_align_at_their_offset():
    whole = np.repeat(np.array([3, 9, 27, 81, 243], np.uint32), 200)
    assert chroma.align(whole[100:], whole) == (-100, 900, 0.0)
    assert chroma.align(whole, whole[100:]) == (100, 900, 0.0)
    rng = np.random.default_rng(5)
    for most in (2, 5, 400):
        a, b = rng.integers(0, most, 700).astype(np.uint32), rng.integers(0, most, 450).astype(np.uint32)
        want = np.bincount((np.arange(700)[:, None] - np.arange(450) + 450)[a[:, None] == b], minlength=1_151)
        assert (chroma.offsets(a, b) == want).all()


def test_null_and_repeated_ids_are_told_apart_by_their_sound(spark):
    rng = np.random.default_rng(7)
    sounds = [chroma.render(rng.normal(size=64).tolist()) for _ in range(4)]
    rows = [(None, sounds[0]), (None, sounds[1]), (7, sounds[2]), (7, sounds[3]), (9, sounds[3]), (None, None), (3, b"")]
    got = chroma.classes(spark.createDataFrame(rows, "id bigint, media binary"), "id", "media").collect()
    sizes = sorted((str(r["id"]), str(r["class_id"]), r["class_size"], r["n_windows"] > 0) for r in got)
    assert sizes == sorted([("None", "None", 1, True), ("None", "None", 1, True), ("7", "7", 1, True), ("7", "7", 2, True), ("9", "7", 2, True), ("None", "3", 2, False), ("3", "3", 2, False)])
    assert all(r["n_links"] == 0 for r in got)


def test_a_long_recording_aligns_with_its_part(spark):
    rng = np.random.default_rng(8)
    whole = np.concatenate([chroma.decode_wav(chroma.render(rng.normal(size=64).tolist())) for _ in range(30)])
    rows = [(1, wav(whole)), (2, wav(whole[3 * chroma.HOP :])), (3, chroma.render(rng.normal(size=64).tolist()))]
    got = {r["id"]: (r["class_id"], r["class_size"]) for r in chroma.classes(spark.createDataFrame(rows, "id bigint, media binary"), "id", "media").collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 1)}
