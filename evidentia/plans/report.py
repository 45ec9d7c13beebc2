"""Reports: one nested row per mission, its JSON, and a Markdown text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import kernels as k
from evidentia.plans.replay import Replay

NO_PROOFS = "array<struct<url:string,excerpt:string,type:string>>"


def evidence_note(official: Column, urls: Column) -> Column:
    return F.when(official > 0, "official source verified").when(urls >= 3, "several sources agree").when(urls == 2, "two secondary sources, not enough").otherwise("one source, not corroborated")


def criterion_details(evaluations: DataFrame, criteria: DataFrame, requirements: DataFrame) -> DataFrame:
    """Per candidate and requirement its status, with proofs only where it is proven or incompatible."""
    grid = evaluations.select("mission_id", "candidate_id", "non_applicable_criteria").join(requirements, "mission_id")
    rows = grid.join(criteria.select("mission_id", "candidate_id", "requirement_id", "status", "proofs"), ["mission_id", "candidate_id", "requirement_id"], "left")
    status = F.when(F.array_contains("non_applicable_criteria", F.col("label")), "non_applicable").otherwise(F.coalesce("status", F.lit("not_proven")))
    return rows.select("mission_id", "candidate_id", "ord", "label", "requested_value", status.alias("status"), F.when(status.isin("proven", "incompatible"), F.coalesce("proofs", F.array().cast(NO_PROOFS))).otherwise(F.array().cast(NO_PROOFS)).alias("proofs"))


def distinct_proofs(criteria: DataFrame) -> DataFrame:
    """The distinct proofs of each candidate by URL and folded excerpt, in order."""
    rows = criteria.select("mission_id", "candidate_id", "ord", F.posexplode("proofs").alias("p", "proof"))
    first = Window.partitionBy("mission_id", "candidate_id", "proof.url", k.udf(k.collapse, "string")("proof.excerpt")).orderBy("ord", "p")
    rows = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return rows.groupBy("mission_id", "candidate_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "p", "proof"))), lambda x: x["proof"]).alias("sources"))


def reports(run: Replay, requirements: DataFrame) -> DataFrame:
    """mission_id, status, final_state, proposed (best first), discarded: one row per mission, from its last wave."""
    last = run.results.select("mission_id", F.col("waves").alias("wave"), "status", "final_state")
    evaluations = run.evaluations.join(last.select("mission_id", "wave"), ["mission_id", "wave"]).filter("error IS NULL")
    criteria = run.criteria.join(last.select("mission_id", "wave"), ["mission_id", "wave"])
    details = criterion_details(evaluations, criteria, requirements)
    line = F.struct("ord", "label", "requested_value", "status", "proofs")
    per = details.groupBy("mission_id", "candidate_id").agg(F.array_sort(F.collect_list(line)).alias("criteria"))
    full = evaluations.join(per, ["mission_id", "candidate_id"]).join(distinct_proofs(criteria), ["mission_id", "candidate_id"], "left")
    same = Window.partitionBy("mission_id", F.lower(F.trim("brand")), F.lower(F.trim("reference"))).orderBy(F.desc("score"), F.desc("official_proof_count"), F.desc("proof_url_count"))
    good = full.filter("eligible").withColumn("_n", F.row_number().over(same)).filter("_n = 1")
    order = (-F.col("score"), -F.col("official_proof_count"), -F.col("proof_url_count"), F.lower("brand"), F.lower("reference"))
    summary = F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)], "brand", "reference", "score", F.when(F.col("complete"), "complete").otherwise("partial").alias("status"), "proven_criteria", "not_proven_criteria", "incompatible_criteria", "non_applicable_criteria", "critical_blockers", "unverified_criteria", "missing_audit_criteria", "rejected_proof_criteria", "official_proof_count", "proof_url_count", "deviations", "limitations", evidence_note(F.col("official_proof_count"), F.col("proof_url_count")).alias("evidence_note"), "sources", "criteria")
    proposed = good.groupBy("mission_id").agg(F.transform(F.array_sort(F.collect_list(summary)), lambda s: s.dropFields(*[f"_{i}" for i in range(5)])).alias("proposed"))
    bad = F.col("incompatible_criteria")
    why = F.when(F.size(bad) == 1, F.concat(F.get(bad, F.lit(0)), F.lit(" incompatible"))).otherwise(F.concat(F.array_join(bad, ", "), F.lit(" incompatible")))
    out = full.filter(~F.col("eligible") & (F.size(bad) > 0)).groupBy("mission_id").agg(F.array_sort(F.collect_list(F.struct("brand", "reference", why.alias("reason"), F.filter("criteria", lambda c: c["status"] == "incompatible").alias("criteria")))).alias("discarded"))
    return last.withColumnRenamed("wave", "waves").join(proposed, "mission_id", "left").join(out, "mission_id", "left")


def as_json(reported: DataFrame) -> DataFrame:
    return reported.select("mission_id", F.to_json(F.struct(*[c for c in reported.columns if c != "mission_id"]), {"ignoreNullFields": "false"}).alias("report"))


def as_markdown(reported: DataFrame) -> DataFrame:
    """mission_id, report: a text for readers."""
    candidate = lambda c: F.concat(F.lit("- "), c["brand"], F.lit(" "), c["reference"], F.lit(": "), c["score"].cast("string"), F.lit(" %, "), c["status"], F.lit(", "), c["evidence_note"], F.lit("; proven: "), F.array_join(c["proven_criteria"], ", "))
    gone = lambda c: F.concat(F.lit("- "), c["brand"], F.lit(" "), c["reference"], F.lit(": "), c["reason"])
    listed = lambda col, f: F.coalesce(F.array_join(F.transform(col, f), "\n"), F.lit("none"))
    return reported.select("mission_id", F.concat(F.lit("# Mission "), F.col("mission_id"), F.lit("\n\nStatus: "), F.col("status"), F.lit(" ("), F.col("final_state"), F.lit(")\n\n## Proposed\n\n"), listed("proposed", candidate), F.lit("\n\n## Discarded\n\n"), listed("discarded", gone), F.lit("\n")).alias("report"))


def failure(status: str, reason: str) -> dict:
    """The document of a run that has no result: invalid_input, configuration_error, analysis_error, service_unavailable."""
    return {"status": status, "alternative": "", "compatibility": None, "proposed_candidates": [], "warnings": [reason], "sources": [], "diagnostics": {}}
