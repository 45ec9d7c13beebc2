"""The made-up corpus end to end: statuses, scores and reports of its four candidates."""

from __future__ import annotations

import json

import pytest

from evidentia.operators.identity import Brands
from evidentia.plans import report
from evidentia.plans.replay import replay_folders
from evidentia.sources import corpus, demo

BRANDS = Brands({frozenset([b]): frozenset(d) for b, d in demo.BRANDS["domaines_officiels"].items()})


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    return replay_folders(spark, [demo.write(tmp_path_factory.mktemp("c") / "m1"), demo.write(tmp_path_factory.mktemp("c") / "m2")], BRANDS)


def test_statuses(run):
    assert {tuple(r) for r in run.results.select("mission_id", "status", "final_state", "waves").collect()} == {("m1", "complete", "candidate_selected", 2), ("m2", "complete", "candidate_selected", 2)}
    last = {r["brand"]: r for r in run.evaluations.filter("wave = 2 AND mission_id = 'm1'").collect()}
    assert {b: (r["score"], r["complete"], r["eligible"]) for b, r in last.items()} == {"Amaro": (100, True, True), "Belix": (100, True, True), "Corun": (0, False, False), "Davel": (66, False, False)}
    assert last["Davel"]["incompatible_criteria"] == ["Supply voltage"] and last["Belix"]["proof_url_count"] == 2
    assert last["Belix"]["limitations"] == ["Stages only by a reseller."] and last["Amaro"]["official_proof_count"] == 3
    assert {r["brand"] for r in run.evaluations.filter("wave = 1").collect()} == {"Amaro", "Davel"}


def test_near_miss_and_journal(run):
    tasks = run.tasks.filter("wave = 2 AND mission_id = 'm1'").collect()
    assert [(t["identity"], t["criterion"], t["path"]) for t in tasks] == [("DV-310", "supply", "ESTABLISHED")]
    assert run.queries.filter("wave = 1 AND mission_id = 'm1'").first()["query"] == 'DV-310 Supply voltage "12 V DC"'
    assert run.journal.filter("mission_id = 'm1' AND brand = 'Amaro'").count() == 1


def test_reports(run, spark, tmp_path):
    requirements = corpus.load(spark, [demo.write(tmp_path / "m1")]).requirements
    made = report.reports(run, requirements).filter("mission_id = 'm1'")
    doc = json.loads(report.as_json(made).first()["report"])
    assert [c["brand"] for c in doc["proposed"]] == ["Amaro", "Belix"] and doc["proposed"][0]["evidence_note"] == "official source verified"
    assert [(c["brand"], c["reason"]) for c in doc["discarded"]] == [("Davel", "Supply voltage incompatible")]
    assert "Amaro AM-310: 100 %" in report.as_markdown(made).first()["report"]


@pytest.mark.parametrize("change, problem", [(lambda m: m.update(threshold=0), "manifest"), (lambda m: m.update(audit_waves=[1]), "audit_waves"), (lambda m: m["page_waves"].pop(demo.AMARO), "page_waves"), (lambda m: m["waves"][1].update(wave=3), "waves")])
def test_unsound_corpora_are_refused(spark, tmp_path, change, problem):
    folder = demo.write(tmp_path / "bad")
    made = demo.manifest()
    change(made)
    (tmp_path / "bad" / "manifest.json").write_text(json.dumps(made))
    with pytest.raises(ValueError, match=problem):
        replay_folders(spark, [folder])


def test_capture_reads_back_the_same(spark, tmp_path):
    first = corpus.load(spark, [demo.write(tmp_path / "m1")])
    manifests = corpus.parse({n: spark.createDataFrame([("m1", v)], "mission_id string, value string") for n, v in demo.tables().items()})
    made = spark.createDataFrame([("m1", json.dumps(demo.manifest()))], "mission_id string, value string")
    from pyspark.sql import functions as F

    from evidentia import schemas

    corpus.write(first, made.select("mission_id", F.from_json("value", schemas.MANIFEST_JSON).alias("v")).select("mission_id", "v.*"), str(tmp_path / "captured"))
    again = corpus.read_captured(spark, str(tmp_path / "captured"))
    for name in ("missions", "requirements", "criteria", "remarks", "pages", "waves"):
        key = lambda c: sorted(map(str, getattr(c, name).collect()))  # noqa: B023, E731
        assert key(again) == key(first) == key(manifests), name
    assert again.problems.count() == 0


def test_command_line(spark, tmp_path):
    from evidentia.__main__ import main

    brands = tmp_path / "brands.json"
    brands.write_text(json.dumps(demo.BRANDS))
    assert main(["--corpus", demo.write(tmp_path / "m9"), "--brands", str(brands), "--output", str(tmp_path / "out")]) == 0
    assert json.loads((tmp_path / "out" / "m9.json").read_text())["status"] == "complete" and "Amaro" in (tmp_path / "out" / "m9.md").read_text()


def test_a_broken_mission_does_not_stop_the_others(spark, tmp_path):
    folders = [demo.write(tmp_path / "good"), demo.write(tmp_path / "bad")]
    (tmp_path / "bad" / "audits.json").write_text('[{"page_url": ')
    run = replay_folders(spark, folders, BRANDS)
    assert {r["mission_id"] for r in run.results.collect()} == {"good"}
    assert ("bad", "audits: broken JSON") in {tuple(r) for r in run.refused.collect()}
