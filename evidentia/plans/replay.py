"""Replay: for each wave of each mission, audits and pages up to it are validated, merged, scored and reported."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.operators import evidence, near_miss, reaudit
from evidentia.operators.identity import Brands
from evidentia.runtime import cut
from evidentia.sources.corpus import Corpus, load, load_tables

MOST_QUERIES, MOST_NEAR_MISS = 12, 3


@dataclass(frozen=True)
class Replay:
    evaluations: DataFrame  # with wave; the last wave's decide
    criteria: DataFrame  # merged criteria with wave
    journal: DataFrame
    tasks: DataFrame
    queries: DataFrame
    results: DataFrame  # mission_id, status, final_state, waves
    refused: DataFrame | None = None  # mission_id, problem of corpora that aren't sound


def by_wave(rows: DataFrame, waves: DataFrame) -> DataFrame:
    """Rows of a mission's waves so far, once for each wave (four at most): mission_id becomes mission#wave."""
    w = waves.select("mission_id", F.col("wave").alias("_w"))
    return rows.join(w, "mission_id").filter(F.col("wave") <= F.col("_w")).withColumn("mission_id", F.concat_ws("#", "mission_id", "_w")).drop("wave", "_w")


def each_wave(rows: DataFrame, waves: DataFrame) -> DataFrame:
    return by_wave(rows.withColumn("wave", F.lit(0)), waves)


def replay(corpus: Corpus, brands: Brands = Brands()) -> Replay:
    waves = corpus.waves
    pages, criteria, remarks = by_wave(corpus.pages, waves), by_wave(corpus.criteria, waves), by_wave(corpus.remarks, waves)
    missions, requirements = each_wave(corpus.missions, waves), each_wave(corpus.requirements, waves)
    # each step is read several times by the next; without cuts the plan would double at each
    missions, requirements, pages = cut(missions), cut(requirements), cut(pages)
    checked = cut(evidence.validate(cut(criteria), requirements, pages))
    merged = cut(evidence.merge(checked))
    # the first pass can only take an incompatibility back; what it opens is proven by the second
    once = cut(reaudit.reaudit(merged, requirements, missions, pages, brands))
    twice = cut(reaudit.reaudit(once.drop("reaudited"), requirements, missions, pages, brands).drop("reaudited"))
    valid = cut(evidence.validate(twice, requirements, pages))
    taken_back = reaudit.downgraded(merged, once, requirements, missions)
    broken = checked.filter("contract_error IS NOT NULL").select(*valid.columns)
    scored = evidence.evaluate(valid.unionByName(broken), requirements, missions, pages, brands)
    scored = scored.join(evidence.merged_remarks(checked, remarks), ["mission_id", "candidate_id"], "left")
    none = F.array().cast("array<string>")
    scored = scored.join(taken_back, ["mission_id", "candidate_id"], "left")
    scored = cut(scored.withColumns({c: F.coalesce(c, none) for c in ("deviations", "limitations", "downgraded")}))
    urls = valid.groupBy("mission_id", "candidate_id").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("proofs.url").alias("u")))), lambda x: x["u"]))).alias("urls"))
    assessed = scored.filter("error IS NULL").join(urls, ["mission_id", "candidate_id"], "left")
    assessed = assessed.withColumn("identity", F.col("reference")).withColumn("family", near_miss.search_family(F.col("reference"), F.coalesce("urls", none)))
    tasks = cut(near_miss.targeted_tasks(near_miss.assess(assessed, requirements)))
    budgets = waves.select(F.concat_ws("#", "mission_id", "wave").alias("mission_id"), F.greatest(F.lit(0), MOST_QUERIES - F.col("logical_queries_before_near_miss")).alias("budget"), F.col("seen_signatures_before_near_miss").alias("seen_signatures"))
    queries = near_miss.select_queries(tasks, budgets)
    last = waves.groupBy("mission_id").agg(F.max("wave").alias("waves"))
    final = missions.join(last.select(F.concat_ws("#", "mission_id", "waves").alias("mission_id"), "waves"), "mission_id")
    results = evidence.mission_status(missions, scored).join(final.select("mission_id", "waves"), "mission_id")
    return Replay(apart(scored), apart(valid), journal(apart(scored)), apart(tasks), apart(queries), apart(results).drop("wave"))


def apart(rows: DataFrame) -> DataFrame:
    """mission#wave as mission_id and wave again."""
    return rows.withColumn("wave", F.element_at(F.split("mission_id", "#"), -1).cast("int")).withColumn("mission_id", F.regexp_replace("mission_id", "#[0-9]+$", ""))


def journal(evaluations: DataFrame) -> DataFrame:
    """What each wave found out, without what an earlier wave said already."""
    facts = ["mission_id", "page_url", "brand", "reference", "score", "eligible", "complete", "official_proof_count", "proof_url_count", "proven_criteria", "not_proven_criteria", "incompatible_criteria", "critical_blockers", "unverified_criteria", "downgraded", "error"]
    first = Window.partitionBy(*facts).orderBy("wave")
    return evaluations.select(*facts, "wave").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def replay_folders(spark: SparkSession, folders: list[str], brands: Brands = Brands()) -> Replay:
    """Replays corpora on disk; a corpus that isn't sound is refused."""
    return checked_replay(load(spark, folders), brands)


def replay_tables(spark: SparkSession, corpora: dict[str, dict[str, str]], brands: Brands = Brands()) -> Replay:
    """Replays corpora given as JSON texts."""
    return checked_replay(load_tables(spark, corpora), brands)


def checked_replay(corpus: Corpus, brands: Brands) -> Replay:
    """The replay of the sound missions, with what is wrong with the others in `refused`. If none is sound, that is an error."""
    bad = cut(corpus.problems)
    if bad.isEmpty():
        return replay(corpus, brands)
    names = bad.select("mission_id").distinct()
    sound = lambda rows: rows.join(names, "mission_id", "left_anti")
    if sound(corpus.missions).isEmpty():
        raise ValueError("; ".join(f"{r['mission_id']}: {r['problem']}" for r in bad.limit(20).collect()))
    kept = {f.name: sound(getattr(corpus, f.name)) for f in fields(corpus) if f.name != "problems"}
    return dataclasses.replace(replay(Corpus(**kept, problems=bad.limit(0)), brands), refused=bad)
