"""Audits of declared candidates: a page is read for given leads, and each lead gets each notable requirement, proven or not.

What a model answers is joined to the grid of a page's leads and its mission's requirements; what it leaves out is not proven,
what it adds is discarded. Both sides of the grid are a mission's few."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.operators.payloads import STATUSES, is_kind, json_value, proofs_of, sanitized, say, text_at, union
from evidentia.runtime import cut
from evidentia.schemas import PROOF

STAGE = "page_audit"


def declared_audits(answers: DataFrame, declared: DataFrame, requirements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(criteria, diagnostics) of answers (mission_id, audit_ord, page_url, answer), in the form of schemas.CRITERIA.

    `declared`: mission_id, audit_ord, candidate_index (from 0), brand, reference; `requirements`: mission_id, ord,
    requirement_id, requested_value of the notable ones. An answer is {candidate_criteria: [{candidate_index, criteria}]}; of
    groups of one index and of criteria of one id the first counts. An answer without that list gives no criteria at all."""
    keys = ["mission_id", "audit_ord"]
    values = answers.select(*keys, "page_url", json_value(F.col("answer")).alias("v")).withColumn("groups", F.try_variant_get("v", "$.candidate_criteria", "array<variant>"))
    values = cut(values.select(*keys, "page_url", "groups", F.col("v").isNull().alias("unread"), is_kind(F.col("v"), "OBJECT").alias("is_object")))
    said = [say(values.filter("unread"), keys, STAGE, F.lit("$"), "json_parse_error", "aborted")]
    said.append(say(values.filter("NOT unread AND groups IS NULL"), keys, STAGE, F.when(F.col("is_object"), "candidate_criteria").otherwise("$"), "invalid_structure", "aborted"))
    whole = values.filter("groups IS NOT NULL")
    said.append(say(whole.filter(F.size("groups") == 0), keys, STAGE, F.lit("candidate_criteria"), "empty_declared_audit", "defaulted_not_proven"))

    groups = whole.select(*keys, "page_url", F.posexplode("groups").alias("n", "g"))
    groups = groups.select(*keys, "page_url", "n", F.try_variant_get("g", "$.candidate_index", "int").alias("candidate_index"), is_kind(F.try_variant_get("g", "$.candidate_index", "variant"), "BOOLEAN").alias("is_flag"), F.try_variant_get("g", "$.criteria", "array<variant>").alias("criteria"))
    known = groups.join(declared.select(*keys, "candidate_index", F.lit(True).alias("known")), [*keys, "candidate_index"], "left")
    fit = F.col("known") & F.col("criteria").isNotNull() & ~F.coalesce("is_flag", F.lit(False))
    first = Window.partitionBy(*keys, F.when(fit, F.col("candidate_index"))).orderBy("n")
    known = cut(known.withColumn("ok", F.coalesce(fit, F.lit(False)) & (F.row_number().over(first) == 1)))
    said.append(say(known.filter("NOT ok"), keys, STAGE, F.concat(F.lit("candidate_criteria["), F.col("n").cast("string"), F.lit("]")), "invalid_item"))
    used = known.filter("ok").select(*keys, "candidate_index", "criteria")

    at = F.concat(F.lit("candidate_criteria["), F.col("candidate_index").cast("string"), F.lit("]"))
    people = declared.join(whole.select(*keys, "page_url", F.size("groups").alias("n_groups")), keys)
    given = people.join(used.select(*keys, "candidate_index", F.size("criteria").alias("n_criteria")), [*keys, "candidate_index"], "left")
    said.append(say(given.filter("n_criteria IS NULL AND n_groups > 0"), keys, STAGE, at, "empty_declared_audit", "defaulted_not_proven"))
    said.append(say(given.filter("n_criteria = 0"), keys, STAGE, F.concat(at, F.lit(".criteria")), "empty_declared_audit", "defaulted_not_proven"))

    wanted = requirements.select("mission_id", "ord", "requirement_id", F.col("requested_value").alias("wanted"))
    items = used.select(*keys, "candidate_index", F.posexplode("criteria").alias("m", "c")).withColumn("at", F.concat(at, F.lit(".criteria["), F.col("m").cast("string"), F.lit("]")))
    items = items.withColumns({f: text_at(F.col("c"), f"$.{f}") for f in ("requirement_id", "requested_value", "observed_value", "status")}).withColumn("raw", F.coalesce(F.try_variant_get("c", "$.proofs", "array<variant>"), F.array().cast("array<variant>")))
    items = items.join(wanted.select("mission_id", "requirement_id", "wanted"), ["mission_id", "requirement_id"], "left")
    good = F.col("wanted").isNotNull() & F.coalesce("status", F.lit("")).isin(*STATUSES)
    nth = Window.partitionBy(*keys, "candidate_index", "requirement_id", F.coalesce(good, F.lit(False))).orderBy("m")
    items = cut(items.withColumn("ok", F.coalesce(good, F.lit(False)) & (F.row_number().over(nth) == 1)).drop("c"))
    said.append(say(items.filter("NOT ok"), keys, STAGE, F.when(F.col("wanted").isNotNull() & ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), F.concat("at", F.lit(".status"))).otherwise(F.col("at")), "invalid_item"))
    said.append(say(items.filter("ok AND requested_value IS NOT NULL AND requested_value != wanted"), keys, STAGE, F.concat("at", F.lit(".requested_value")), "invalid_item"))
    answered = items.filter("ok").select(*keys, "candidate_index", "requirement_id", "observed_value", "status", "raw")

    grid = people.drop("n_groups").join(wanted, "mission_id").join(answered, [*keys, "candidate_index", "requirement_id"], "left")
    proofs = F.coalesce(proofs_of(F.col("raw"), F.col("page_url")), F.array().cast(f"array<{PROOF}>"))
    out = grid.select("mission_id", F.concat_ws("/", "audit_ord", "candidate_index").alias("candidate_id"), "brand", "reference", "page_url", "audit_ord", "ord", "requirement_id", F.col("wanted").alias("requested_value"), F.coalesce("observed_value", F.lit("")).alias("observed_value"), F.coalesce("status", F.lit("not_proven")).alias("status"), proofs.alias("proofs"))
    return out, sanitized(union(said))
