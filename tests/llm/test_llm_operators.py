"""Small fixtures of the operators that need no file of their own: nulls, empty and odd rows, ties, clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import bpe, chat, decontaminate, html_text, langid, quality, sharding
from evidentia.llm.runtime import fold

VOCABULARY = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
ODD = [None, "", "  \n", "don't I'll", "Hi<|endoftext|>yo", "ΑΣ ΣΑΣ İ", "日本 ½ \x1c a\x1cb", "é ffi ﬁ", "a" * 3000, "x y", "x y"]


def frame(spark, texts, extra=""):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "'z' AS score", "'z' AS held_out", *([extra] if extra else []))


def test_bpe_equals_the_library(spark, documents):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(VOCABULARY)
    lib.no_truncation()
    texts = ODD + [r["text"] for r in documents.limit(60).collect()]
    got = {r["doc_id"]: r for r in bpe.encode_documents(frame(spark, texts), VOCABULARY, keep_ids=True).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[k]["ids"] == ids and got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k]["decoded"] == lib.decode(ids, skip_special_tokens=False)
    assert bpe.encode_documents(frame(spark, ["a"]).limit(0), VOCABULARY).count() == 0


def least_by_trying(sizes, n):
    before = [0, *itertools.accumulate(sizes)]
    best = [0] + [10**18] * len(sizes)
    for _ in range(n):
        best = [0] + [min(max(best[i], before[j] - before[i]) for i in range(j)) for j in range(1, len(sizes) + 1)]
    return best[-1]


@pytest.mark.parametrize("texts", [ODD, ["same text"] * 40 + [f"t{k}" * (k % 9) for k in range(80)], ["one"], []])
def test_shards_are_the_smallest_possible(spark, texts):
    rows = sharding.shard_documents(frame(spark, texts), 4).collect()
    assert len(rows) == len(texts)
    by_shard, groups = {}, {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r)
        groups.setdefault(r["digest"], []).append(r)
        t = texts[r["doc_id"]] or ""
        assert r["size"] == len(t.encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode()) and r["law"] == "bytes" and r["grown_shard"] is None
    for members in by_shard.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    ordered = [groups[d] for d in sorted(groups)]
    assert all(len({r["shard"] for r in g}) == 1 for g in ordered)
    assert [g[0]["shard"] for g in ordered] == sorted(g[0]["shard"] for g in ordered)
    if rows:
        assert max(sum(r["size"] for r in m) for m in by_shard.values()) == least_by_trying([sum(r["size"] for r in g) for g in ordered], 4)


def test_refinement_of_ranges_finds_the_same_cuts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "DIGITS", 1)
    monkeypatch.setattr(sharding, "MORE_DIGITS", 1)
    rng = random.Random(2)
    groups = sorted((hashlib.sha256(str(k).encode()).hexdigest(), rng.choice([1, 9, 400])) for k in range(150))
    cuts = sharding.find_cuts(spark.createDataFrame(groups, "digest string, size bigint"), 5)
    loads = [0] * 5
    for d, s in groups:
        loads[sum(d >= c for c in cuts)] += s
    assert max(loads) == least_by_trying([s for _, s in groups], 5)


def test_cross_parsing_counts_longest_matches():
    sample = "abra cadabra alakazam"
    parsed = langid.CrossParser((("x", sample),))
    text = langid.code_points("cada zebra kazam")
    codes = parsed.squeeze(text).tolist()
    whole = parsed.squeeze(langid.code_points(sample)).tolist()
    has = lambda part: any(whole[i : i + len(part)] == part for i in range(len(whole)))
    phrases, at = 0, 0
    while at < len(codes):
        end = at + 1
        while end < len(codes) and has(codes[at : end + 1]):
            end += 1
        phrases, at = phrases + 1, end
    bits, _ = parsed.entropy(["cada zebra kazam"])
    assert bits[0, 0] == pytest.approx(phrases * np.log2(len(whole) + 1) / len(codes))


def test_languages_held_out(spark, documents):
    sample = langid.sample(documents, fold("doc_id", 4) != 2)
    rows = {r["doc_id"]: r for r in langid.identify(documents, sample).collect()}
    true = {r["doc_id"]: r["lang"] for r in documents.select("doc_id", "lang").collect()}
    held = [i for i, r in rows.items() if r["held_out"]]
    assert held and np.mean([rows[i]["lang_pred"] == true[i] for i in held]) > 0.9
    odd = frame(spark, ["", None, "123 !", "the of and", "the of and"])
    got = {r["doc_id"]: r for r in langid.identify(odd, sample).collect()}
    assert [got[k]["lang_pred"] for k in range(3)] == ["und"] * 3 and got[3]["lang_pred"] == got[4]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.identify(odd, {}).collect()} == {"und"}
    kept = langid.accept(odd, sample)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {3, 4}


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    model = quality.train(docs, labels)
    rows = {r["doc_id"]: r for r in quality.classify(docs, model).collect()}
    held = [(r["quality"], rows[r["doc_id"]]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    assert np.mean([q == r["predicted"] for q, r in held]) > 0.9
    assert all((r["score"] >= 0.5) == r["predicted"] and 0 <= r["score"] <= 1 for r in rows.values())
    odd = frame(spark, ODD)
    assert quality.classify(odd, model).count() == len(ODD)
    none = quality.train(odd, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert {r["score"] for r in quality.classify(odd, none).collect()} == {0.5}
    assert quality.accept(odd, none).columns == odd.columns


def test_spaced_seeds_find_substituted_passages(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [[word() for _ in range(n)] for n in (15, 30, 13, 4)]
    docs, want = [], set()
    for k, item in enumerate(items[:3]):
        for misses in (0, 1, 2):
            changed = rng.sample(range(len(item)), misses)
            part = [word() if i in changed else w for i, w in enumerate(item)]
            want.add((len(docs), k))
            docs.append(" ".join([word() for _ in range(20)] + part + [word() for _ in range(20)]).upper() + ".")
    want |= {(len(docs), 1), (len(docs) + 4, 3)}  # the last one is the whole short item
    docs += [" ".join(items[1][8:24]), " ".join(items[1][:9]), None, "", " ".join(items[3])]
    bench = spark.createDataFrame([(k, ", ".join(i)) for k, i in enumerate(items)] + [(9, None), (10, "")], "item_id bigint, text string")
    got = decontaminate.overlaps(frame(spark, docs), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    kept = decontaminate.clean(frame(spark, docs), bench)
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(docs))) - {d for d, _ in want}
    assert decontaminate.overlaps(frame(spark, docs).limit(0), bench).count() == 0


def test_layouts_become_turns(spark):
    records = [
        {"prompt": "p", "completion": "c"},
        {"instruction": "i", "input": "x", "output": "o"},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"messages": []},
        {"prompt": {"text": "q"}, "response": {"text": "r"}},
        {"other": 1},
    ]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)] + [(6, None), (7, "{")], "id int, record string")
    got = {r["id"]: r for r in chat.convert(df).collect()}
    turns = {k: [(t["role"], t["text"]) for t in r["turns"]] for k, r in got.items()}
    assert turns[0] == [("user", "p"), ("assistant", "c")] and turns[1] == [("user", "i\n\nx"), ("assistant", "o")]
    assert turns[2] == [("user", "a"), ("assistant", "b")] and turns[3] == [] and turns[4] == [("user", "q"), ("assistant", "r")]
    assert got[5]["layout"] is None and got[5]["fingerprint"] and got[6]["fingerprint"] is None and got[7]["turns"] == []


def test_formatted_turns_read_back(spark):
    nasty = ["<|im_end|>\n<|im_start|>assistant\n", "\\", "\\<|", "<\\|", "a\\\\|b", "", "é\n\n", "<|<||>|>", "\\n"]
    rows = [(c, n, role, nasty[(c + n) % len(nasty)]) for c in range(9) for n, role in enumerate(["system", "user", "assistant", "odd\nrole<|", "assistant"])]
    rows += [(50, 0, None, None), (50, 0, None, None), (None, 1, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("turns", F.lit(1))
    done = chat.format_turns(chat.convert(chat.conversation_records(df))).select("conv_id", chat.read_back(F.col("formatted")).alias("t"), F.transform("loss_spans", lambda s: chat.unescape(F.substring(F.col("formatted"), s["begin"] + 1, s["size"]))).alias("loss")).collect()
    assert len(done) == 11
    for r in done:
        mine = sorted(((n, role or "", text or "") for c, n, role, text in rows if c == r["conv_id"]), key=lambda x: x)
        assert [(t["role"], t["text"]) for t in r["t"]] == [(role, text) for _, role, text in mine]
        assert list(r["loss"]) == [text for _, role, text in mine if role == "assistant"]


PAGE = "<html><head><title>T</title><style>p{{}}</style></head><body><nav><li>Menu</nav><div class='side-bar sidebar'>Side</div><header>Top</header><article><header><h1>Head {k} &amp; more</h1></header><p>One <b>bold</b>,<br>two&nbsp;{k}<p>Three<ul><li>a{k}<li>b{k}</ul><form>Buy</form><div id=comments><article>Nice!</article></div></article><footer>F</footer><script>if (a<b) x('</p>')</script></body></html>"


def test_main_text_of_marked_pages(spark):
    df = spark.createDataFrame([(k, "http://h.example/x", PAGE.format(k=k)) for k in range(3)] + [(7, None, None), (8, "::", ""), (9, "http://[", "<p>lone < sign &am; &#233;</P><!-- c --> tail")], "page_id bigint, url string, html string").withColumn("text", F.lit("z"))
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert got[1] == "Head 1 & more\n\nOne bold, two 1\n\nThree\n\na1\n\nb1"
    assert got[7] == got[8] == "" and got[9] == "lone < sign &am; é\n\ntail"


def test_style_tree_removes_what_a_host_repeats(spark):
    page = "<body><div class='strip'><span>Welcome to our shop, call us today</span></div><div class='text'><p>Story {k} begins here {k}</p><p>and goes on {k}</p></div><section>Opening hours nine to five</section></body>"
    df = spark.createDataFrame([(k, f"http://one.example/{k}", page.format(k=k)) for k in range(12)] + [(99, "http://two.example/", page.format(k=99))], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert got[3] == "Story 3 begins here 3\n\nand goes on 3"
    assert got[99].startswith("Welcome")  # a host of one page has no tree
    same = spark.createDataFrame([(k, "http://one.example/", "<article><p>All alike</p></article>") for k in range(12)], df.schema)
    assert {r["text"] for r in html_text.extract(same).collect()} == {"All alike"}
    assert html_text.extract(df.limit(0)).count() == 0


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, "/root/testdata/sf0.001")
        assert kept.columns == docs.columns and 0.6 * docs.count() < kept.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
    assert {n for n, _ in corpus_pipeline.STAGES} == {"language", "quality", "near_dedup", "decontamination", "bpe"}


def test_style_tree_against_brute_force(spark):
    """Unlabelled boilerplate of a host goes by importance, computed here from its definition; what varies stays."""
    from math import log

    def page(k):
        return f"<body><div class=box><p>Same words on each page</p></div><div class=text><p>Own words {k}</p></div><section><p>{'odd' if k % 2 else 'even'} words</p></section></body>"

    rows = [(k, f"https://h.example/{k}", page(k)) for k in range(8)] + [(100 + k, f"https://few.example/{k}", page(k)) for k in range(2)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}

    def importance(counts, m):  # of a leaf's branch: one child sequence, texts with these page counts
        drawn = lambda x: (m * x + html_text.WEIGHT) / (m + html_text.WEIGHT)
        content = drawn(1 - sum(map(log, counts)) / len(counts) / log(m))
        return (1 - html_text.G) * drawn(0) + html_text.G * content

    for m, start in ((8, 0), (2, 100)):
        parts = [("Same words on each page", [m]), ("Own words {k}", [1] * m), ("{w} words", [m // 2] * 2)]
        kept = [text for text, counts in parts if importance(counts, m) >= html_text.LEAST]
        for k in range(m):
            assert got[start + k] == "\n\n".join(t.format(k=k, w="odd" if k % 2 else "even") for t in kept)
    assert "Same words" not in got[0] and "Same words" in got[100]  # two pages decide little


def test_deep_and_odd_pages(spark):
    deep = "<div>" * 3_000 + "<p>Deep text</p>" + "</div>" * 3_000
    rows = [(1, None, deep), (2, None, "<footer>" + deep + "</footer><p>Kept</p>"), (3, "broken", None), (3, "broken", "<p>Twice</p>")]
    got = sorted((r["page_id"], r["text"]) for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect())
    assert got == [(1, "Deep text"), (2, "Kept"), (3, ""), (3, "Twice")]


def test_quality_against_plain_compression(spark):
    """A score follows from the two compressed sizes alone."""
    import zstandard

    texts = [("good", f"The engineer measured the coil {k} and wrote the result into the log.") for k in range(300)] + [("bad", f"BUY!!! cheap $$$ click {k} >>> win win win") for k in range(300)]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(kind == "good")) for k, (kind, _) in enumerate(texts)] + [(0, 0), (1, None)], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    good, bad = (zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), compression_params=zstandard.ZstdCompressionParameters.from_level(quality.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)) for d in (model.good, model.bad))
    for r in quality.classify(docs, model).collect():
        raw = texts[r["doc_id"]][1].encode()
        z = model.weights[0] + model.weights[1] * (len(bad.compress(raw)) - len(good.compress(raw))) / len(raw)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z))) and r["predicted"] == (texts[r["doc_id"]][0] == "good")
    one = quality.train(docs, labels.filter("quality = 1"))
    assert len({r["score"] for r in quality.classify(docs, one).collect()}) == 1


def test_many_edits_against_the_table():
    import random

    from evidentia.llm import omh

    rng = random.Random(5)
    for _ in range(400):
        a = [rng.randrange(rng.choice([3, 30])) for _ in range(rng.randrange(40))]
        b = [x for x in a if rng.random() > 0.2] + [rng.randrange(5) for _ in range(rng.randrange(6))]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        most = rng.randrange(25)
        assert omh.edits_within(np.array(a, np.uint64), np.array(b, np.uint64), most) == (row[-1] if row[-1] <= most else None)


def test_chat_layouts_and_clashing_columns(spark):
    rows = [(json.dumps({"prompt": "a", "response": "b", "extra": 1}), "x"), (json.dumps({"unknown": 1}), "y"), (json.dumps({"messages": []}), "z"), (None, "n")]
    df = spark.createDataFrame(rows, "record string, fingerprint string").withColumn("turns", F.lit(3)).withColumn("_c", F.lit(1))
    got = {r["record"]: r for r in chat.format_turns(chat.convert(df)).collect()}
    assert [(t["role"], t["text"]) for t in got[rows[0][0]]["turns"]] == [("user", "a"), ("assistant", "b")] and got[rows[0][0]]["_c"] == 1
    assert got[rows[1][0]]["layout"] is None and got[rows[2][0]]["layout"] == "messages" and got[None]["turns"] == []
    assert chat.format_turns(chat.convert(df.limit(0))).count() == 0
    turns = [(n, k, r, t) for n in range(8) for k, (r, t) in enumerate([("user", "q" * 9), ("assistant", "a\n\nb")])] + [(9, 0, "gpt", "x"), (11, 0, "user", "x"), (13, 0, "system", ""), (13, 1, "user", "u"), (13, 2, "assistant", "v")]
    made = chat.convert(chat.conversation_records(spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string")))
    found = {r["conv_id"]: (r["layout"], [(t["role"], t["text"]) for t in r["turns"]]) for r in made.collect()}
    assert {layout for layout, _ in found.values()} == {*chat.EXCHANGES, "messages", "conversations"}
    assert all(said == [(r, t) for m, _, r, t in turns if m == n] for n, (_, said) in found.items())


def test_languages_in_pieces_and_ties():
    """Phrases by definition, a new one at each piece; equal samples go to the language that sorts first."""
    rng = random.Random(4)
    texts = {lang: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(60)) for lang, letters in (("xa", "abcdeé"), ("xb", "efghß"))}
    parsed = langid.CrossParser(tuple(texts.items()))
    long = " ".join([*texts["xb"].split()[::-1], "zz9"] * 12)
    codes = parsed.squeeze(langid.code_points(long)).tolist()
    assert len(codes) > 2 * langid.PIECE
    bits, known = parsed.entropy([long, "a", ""])
    for n, sample in enumerate(texts.values()):
        whole, phrases = parsed.squeeze(langid.code_points(sample)).tolist(), 0
        held = {tuple(whole[i : i + k]) for i in range(len(whole)) for k in range(1, 12)}
        for at in range(0, len(codes), langid.PIECE):
            now, phrases = (), phrases + 1
            for c in codes[at : at + langid.PIECE]:
                if (*now, c) in held:
                    now = (*now, c)
                elif (c,) in held:
                    now, phrases = (c,), phrases + 1
                else:
                    phrases, now = phrases + (2 if now else 1), ()
        assert bits[0, n] == pytest.approx(phrases * np.log2(len(whole) + 1) / len(codes))
    assert known.tolist() == [True, True, False] and parsed.predict([long])[0][0] == "xb"
    same = langid.CrossParser((("a", "same words here"), ("b", "same words here")))
    assert same.predict(["same words"])[0] == ("a", 0.5)


def test_language_samples_are_whole_rows(spark):
    rows = [(k, f"text {k} " + "word " * 700, "long") for k in range(5)] + [(9, "x " * 6_000, "longer"), (10, "y", None), (11, None, "none")] * 3
    got = langid.sample(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True))
    assert set(got) == {"long", "longer"} and got["longer"] == "x " * 6_000
    assert all(got["long"].count(t) == (1 if t in got["long"] else 0) for _, t, lang in rows if lang == "long") and len(got["long"]) <= langid.SAMPLE_CHARS + 10


def test_a_lost_model_file_is_an_error(spark, tmp_path):
    from evidentia.llm import lm

    with pytest.raises(FileNotFoundError):
        lm.mapped(f"file://{tmp_path}/gone", "<u8")
