"""Sections of a report from diagnostics: allow-listed fields only, always of one schema, and their Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Modes of waves, fields of leads, and reasons why nothing was resolved.
WAVE_MODES = ("discovery", "targeted", "near_miss")
LEAD_FIELDS = ("title", "snippet", "url", "content")
UNRESOLVED = ("NO_PROVABLE_CANDIDATE", "PRODUCT_CONTENT_NOT_RETRIEVED", "NO_VALIDATED_IDENTITY", "NO_PAGE_RETRIEVED")


def safe_int(c: Column) -> Column:
    """A number that isn't negative, or null."""
    return F.when(c >= 0, c.cast("bigint"))


def safe_text(c: Column) -> Column:
    """A text that isn't blank, or null."""
    return F.when(F.trim(c) != "", c)


def safe_names(c: Column, allowed: tuple[str, ...]) -> Column:
    """The allowed ones of a list, in order."""
    return F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isin(*allowed))


def texts(c: Column) -> Column:
    return F.coalesce(F.filter(c, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def by_mission(rows: DataFrame, name: str, item: Column, *order: str) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(o).alias(f"_{o}") for o in order], item.alias("item")))), lambda x: x["item"])
    return rows.groupBy("mission_id").agg(listed.alias(name))


def leads_section(leads: DataFrame) -> DataFrame:
    """mission_id, candidate_leads; `leads`: mission_id, rank, brand, reference, source_count, fields."""
    rows = leads.withColumns({"brand": safe_text(F.col("brand")), "reference": safe_text(F.col("reference")), "source_count": safe_int(F.col("source_count")), "fields": safe_names(F.col("fields"), LEAD_FIELDS)}).filter("brand IS NOT NULL AND reference IS NOT NULL AND source_count IS NOT NULL")
    return by_mission(rows, "candidate_leads", F.struct("brand", "reference", "source_count", "fields"), "rank")


def rejections_section(rejected: DataFrame, reasons: tuple[str, ...]) -> DataFrame:
    """mission_id, rejected_candidates of known reasons; `rejected`: mission_id, ord, brand, reference, reason."""
    rows = rejected.filter(F.col("reason").isin(*reasons)).withColumns({"brand": safe_text(F.col("brand")), "reference": safe_text(F.col("reference"))}).filter("brand IS NOT NULL AND reference IS NOT NULL")
    return by_mission(rows, "rejected_candidates", F.struct("brand", "reference", "reason"), "ord")


def gate_section(gate: DataFrame) -> DataFrame:
    """mission_id, gate_rejections; `gate`: mission_id, ord, url, reason, expected, matched."""
    return by_mission(gate, "gate_rejections", F.struct("url", "reason", texts(F.col("expected")).alias("expected_identifiers"), texts(F.col("matched")).alias("matched_identifiers")), "ord")


def waves_section(waves: DataFrame) -> DataFrame:
    """mission_id, waves; `waves`: mission_id, wave_index, mode, query_count, logical_queries_before, logical_queries_after, task_types."""
    numbers = ("query_count", "logical_queries_before", "logical_queries_after")
    item = F.struct("wave_index", F.when(F.col("mode").isin(*WAVE_MODES), F.col("mode")).otherwise("").alias("mode"), *[F.coalesce(safe_int(F.col(n)), F.lit(0).cast("bigint")).alias(n) for n in numbers], texts(F.col("task_types")).alias("task_types"))
    return by_mission(waves.filter(safe_int(F.col("wave_index")).isNotNull()), "waves", item, "wave_index")


def skipped_section(skipped: DataFrame) -> DataFrame:
    """mission_id, skipped_candidates: why rejected candidates opened no targeted search."""
    item = F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ("reason", "identity", "family")], F.coalesce(safe_int(F.col("proven_compatible_count")), F.lit(0).cast("bigint")).alias("proven_compatible_count"), *[texts(F.col(c)).alias(c) for c in ("blocking_criteria", "missing_criteria")])
    return by_mission(skipped, "skipped_candidates", item, "ord")


def near_miss_section(missions: DataFrame, tasks: DataFrame, selected: DataFrame, skipped: DataFrame) -> DataFrame:
    """mission_id, near_miss of every mission, all zero where nothing happened.

    `tasks`: mission_id, signature, path, criterion, target, reason, priority; `selected`: mission_id, signature."""
    n = lambda rows, name: rows.groupBy("mission_id").agg(F.count("*").alias(name))
    chosen = tasks.join(selected.select("mission_id", "signature").distinct(), ["mission_id", "signature"], "left_semi")
    item = F.struct("signature", *[F.coalesce(old, F.lit("")).alias(new) for old, new in (("path", "eligibility_path"), ("criterion", "blocking_criterion"), ("target", "target_value"), ("reason", "reason"))])
    out = missions.select("mission_id")
    for part in (n(tasks, "tasks_generated"), n(chosen, "tasks_selected"), by_mission(chosen, "selected_tasks", item, "priority"), skipped_section(skipped)):
        out = out.join(part, "mission_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    shown = F.struct(zero("tasks_generated"), zero("tasks_selected"), *[F.coalesce(c, F.from_json(F.lit("[]"), out.schema[c].dataType)).alias(c) for c in ("selected_tasks", "skipped_candidates")])
    return out.select("mission_id", shown.alias("near_miss"))


def unresolved_reason(counters: DataFrame) -> DataFrame:
    """counters (mission_id, status, pages_fetched, pages_analyzed, pages_rejected_by_gate, pages_not_ready_for_evidence) with
    `reason`: of a mission that isn't resolved, how far its pages came."""
    steps = zip(("pages_analyzed", "pages_rejected_by_gate", "pages_not_ready_for_evidence"), UNRESOLVED)
    reason = F.coalesce(*[F.when(F.col(c) > 0, r) for c, r in steps], F.when(F.col("pages_fetched") == 0, UNRESOLVED[3]))
    return counters.withColumn("reason", F.when(F.col("status") == "not_resolved", reason))


def markdown(rows: DataFrame) -> DataFrame:
    """mission_id, section: waves and near-miss search as Markdown; `rows`: mission_id, waves, near_miss."""
    wave = lambda w: F.concat(F.lit("- Wave "), w["wave_index"].cast("string"), F.lit(" ("), w["mode"], F.lit("): "), w["query_count"].cast("string"), F.lit(" queries"))
    task = lambda t: F.concat(F.lit("- "), t["blocking_criterion"], F.lit(": "), t["target_value"])
    skipped = lambda s: F.concat(F.lit("- not followed: "), s["identity"], F.lit(" ("), s["reason"], F.lit(")"))
    lines = F.concat(F.array(F.lit("## Waves")), F.transform("waves", wave), F.array(F.lit("## Targeted search")), F.transform("near_miss.selected_tasks", task), F.transform("near_miss.skipped_candidates", skipped))
    return rows.select("mission_id", F.array_join(lines, "\n").alias("section"))
