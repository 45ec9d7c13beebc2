"""Answers of models as rows: the JSON in a text, validated item by item, with what is wrong as diagnostics.

Answers are parsed into VARIANT values, so one broken answer or item never stops the others. Diagnostics are rows
(stage, path, issue, action) from fixed lists; nothing of an answer's own text goes into them."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import kernels as k
from evidentia.operators.coverage import unit_disagreements

# Stages, issues and actions of diagnostics; and the fields that a path may end with.
STAGES = ("requirement_initial_extraction", "requirement_text_supplement", "requirement_visual_supplement", "page_audit")
ISSUES = ("invalid_item", "invalid_structure", "json_parse_error", "unit_label_disagreement", "temporary_model_unavailable", "empty_declared_audit")
ACTIONS = ("aborted", "discarded", "retried", "retry_failed", "review", "defaulted_not_proven")
FIELDS = ("id", "label", "requested_value", "critical", "evidence_excerpt", "page", "table", "column", "requirement_id", "observed_value", "status", "proofs", "brand", "reference", "criteria", "candidate_criteria")
# Statuses, types of proofs, and what models say for an official source.
STATUSES, PROOF_TYPES = ("proven", "incompatible", "not_proven"), ("web_officiel", "web_secondaire")
OFFICIAL = ("officiel", "official", "web_official", "site_officiel", "fabricant", "manufacturer", "constructeur")
# Seconds before the repeated calls of a model, and the longest that a server may ask for.
RETRY_DELAYS, LONGEST_DELAY = (1, 3, 8, 20), 60


def first_json(text: str | None, wanted: str = "any") -> str | None:
    """The first JSON value of a model's text, also behind words or in a code fence; `list`: the first list, or the list
    under `queries` of an object. Null if there is none."""
    decoder, source = json.JSONDecoder(), (text or "").strip()
    for part in [source, *re.split(r"```(?:json)?", source, flags=re.I)[1::2]]:
        for at in (j for j, c in enumerate(part) if c in "[{"):
            try:
                value, _ = decoder.raw_decode(part, at)
            except ValueError:
                continue
            if wanted == "list":
                value = value.get("queries") if isinstance(value, dict) else value
                if not isinstance(value, list):
                    continue
            return json.dumps(value, ensure_ascii=False)
    return None


def json_value(answer: Column) -> Column:
    """first_json() as VARIANT."""
    return F.try_parse_json(k.udf(first_json, "string")(answer))


def query_list(answer: Column) -> Column:
    """The texts of a model's list of queries; null without a list."""
    return F.try_variant_get(F.try_parse_json(k.udf(lambda t: first_json(t, "list"), "string")(answer)), "$", "array<string>")


def is_kind(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def text_at(value: Column, path: str) -> Column:
    """A text field, null where it is missing or no text."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(is_kind(found, "STRING"), F.try_variant_get(value, path, "string"))


def safe_path(path: Column) -> Column:
    """A path of the known form, or `$`."""
    part = r"(product|origin_brand|(criteria|candidates|candidate_criteria)(\[\d+\])?(\.(" + "|".join(FIELDS) + r")(\[\d+\])?(\.type)?)*)"
    return F.when(path.rlike(f"^{part}$"), path).otherwise("$")


def sanitized(diagnostics: DataFrame) -> DataFrame:
    """Diagnostics (stage, path, issue, action and others) of known kinds, with safe paths."""
    known = F.col("stage").isin(*STAGES) & F.col("issue").isin(*ISSUES) & F.col("action").isin(*ACTIONS)
    return diagnostics.filter(known).withColumn("path", safe_path(F.coalesce("path", F.lit(""))))


def say(rows: DataFrame, keys: list[str], stage: str, path: Column, issue: str, action: str = "discarded") -> DataFrame:
    return rows.select(*keys, F.lit(stage).alias("stage"), path.alias("path"), F.lit(issue).alias("issue"), F.lit(action).alias("action"))


def requirements_of(answers: DataFrame, stage: str = STAGES[0]) -> tuple[DataFrame, DataFrame]:
    """(requirements, diagnostics) of answers (mission_id, answer): items with an id, a label and a value, the first of an id.

    An answer without JSON or a list of criteria is aborted; blank fields, missing ones and repeated ids are discarded one by
    one; units that disagree with the label are kept for review. Supplements must also quote their evidence."""
    values = answers.select("mission_id", json_value(F.col("answer")).alias("v"))
    criteria = F.try_variant_get("v", "$.criteria", "array<variant>")
    said = [say(values.filter("v IS NULL"), ["mission_id"], stage, F.lit("$"), "json_parse_error", "aborted"), say(values.filter(F.col("v").isNotNull() & criteria.isNull()), ["mission_id"], stage, F.when(is_kind(F.col("v"), "OBJECT"), "criteria").otherwise("$"), "invalid_structure", "aborted")]
    items = values.select("mission_id", F.posexplode(criteria).alias("ord", "c"))
    fields = ("id", "label", "requested_value") + (("evidence_excerpt",) if stage != STAGES[0] else ())
    items = items.select("mission_id", "ord", *[text_at(F.col("c"), f"$.{f}").alias(f) for f in fields], F.coalesce(F.try_variant_get("c", "$.critical", "boolean"), F.lit(True)).alias("critical"))
    at = lambda f: F.concat(F.lit("criteria["), F.col("ord").cast("string"), F.lit(f"].{f}"))
    blank = {f: F.trim(F.coalesce(f, F.lit(""))) == "" for f in fields}
    said += [say(items.filter(test), ["mission_id"], stage, at(f), "invalid_item") for f, test in blank.items()]
    whole = items
    for test in blank.values():
        whole = whole.filter(~test)
    whole = whole.withColumn("n", F.row_number().over(Window.partitionBy("mission_id", "id").orderBy("ord")))
    said.append(say(whole.filter("n > 1"), ["mission_id"], stage, at("id"), "invalid_item"))
    kept = unit_disagreements(whole.filter("n = 1").drop("n"))
    said.append(say(kept.filter("review"), ["mission_id"], stage, at("requested_value"), "unit_label_disagreement", "review"))
    extra = ["evidence_excerpt"] if stage != STAGES[0] else []
    out = kept.select("mission_id", "ord", F.trim("id").alias("requirement_id"), F.trim("label").alias("label"), F.trim("requested_value").alias("requested_value"), "critical", *extra)
    return out, sanitized(union(said))


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def proof_type(proof: Column) -> Column:
    return F.lower(F.trim(F.coalesce(F.try_variant_get(proof, "$.type", "string"), F.lit(""))))


def proofs_of(raw: Column, page: Column) -> Column:
    """Whole proofs of an array of VARIANT values: a bare text is an excerpt of the page, an unknown type is secondary."""

    def made(p: Column) -> Column:
        text = F.struct(page.alias("url"), F.trim(F.try_variant_get(p, "$", "string")).alias("excerpt"), F.lit("web_secondaire").alias("type"))
        kind = F.when(proof_type(p).isin(*PROOF_TYPES), proof_type(p)).when(proof_type(p).isin(*OFFICIAL), "web_officiel").otherwise("web_secondaire")
        return F.when(is_kind(p, "STRING"), text).otherwise(F.struct(F.try_variant_get(p, "$.url", "string").alias("url"), F.try_variant_get(p, "$.excerpt", "string").alias("excerpt"), kind.alias("type")))

    return F.filter(F.transform(raw, made), lambda p: (F.coalesce(p["url"], F.lit("")) != "") & (F.coalesce(p["excerpt"], F.lit("")) != ""))


def audits_of(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(criteria, diagnostics) of audit answers (mission_id, audit_ord, page_url, answer), in the form of schemas.CRITERIA.

    A candidate needs brand and reference, a criterion its id, the requested value and a known status; what lacks them is
    discarded alone. A proof that is a bare text is an excerpt of the audited page; an unknown type of proof becomes official
    only by a word for it; neither gives credit, since excerpts are checked on their pages."""
    keys, stage = ["mission_id", "audit_ord"], "page_audit"
    values = answers.select(*keys, "page_url", json_value(F.col("answer")).alias("v"))
    listed = F.try_variant_get("v", "$.candidates", "array<variant>")
    said = [say(values.filter("v IS NULL"), keys, stage, F.lit("$"), "json_parse_error", "aborted"), say(values.filter(F.col("v").isNotNull() & listed.isNull()), keys, stage, F.when(is_kind(F.col("v"), "OBJECT"), "candidates").otherwise("$"), "invalid_structure", "aborted")]
    people = values.select(*keys, "page_url", F.posexplode(listed).alias("c_ord", "c"))
    people = people.select(*keys, "page_url", "c_ord", F.concat(F.lit("candidates["), F.col("c_ord").cast("string"), F.lit("]")).alias("at"), is_kind(F.col("c"), "OBJECT").alias("is_object"), *[F.trim(text_at(F.col("c"), f"$.{f}")).alias(f) for f in ("brand", "reference")], F.try_variant_get("c", "$.criteria", "array<variant>").alias("criteria"))
    named = (F.coalesce("brand", F.lit("")) != "") & (F.coalesce("reference", F.lit("")) != "")
    no_list = F.col("criteria").isNull() | (F.size("criteria") == 0)
    said.append(say(people.filter("NOT is_object"), keys, stage, F.col("at"), "invalid_item"))
    said.append(say(people.filter(F.col("is_object") & no_list), keys, stage, F.concat("at", F.lit(".criteria")), "invalid_item"))
    said += [say(people.filter(F.col("is_object") & ~no_list & (F.coalesce(f, F.lit("")) == "")), keys, stage, F.concat("at", F.lit(f".{f}")), "invalid_item") for f in ("brand", "reference")]
    rows = people.filter(F.col("is_object") & ~no_list & named).select(*keys, "page_url", "c_ord", "at", "brand", "reference", F.posexplode("criteria").alias("ord", "k"))
    rows = rows.withColumn("at", F.concat("at", F.lit(".criteria["), F.col("ord").cast("string"), F.lit("]")))
    rows = rows.withColumns({f: text_at(F.col("k"), f"$.{f}") for f in ("requirement_id", "requested_value", "observed_value", "status")}).withColumn("raw", F.coalesce(F.try_variant_get("k", "$.proofs", "array<variant>"), F.array().cast("array<variant>")))
    wrong = {"requirement_id": F.trim(F.coalesce("requirement_id", F.lit(""))) == "", "requested_value": F.col("requested_value").isNull(), "status": ~F.coalesce("status", F.lit("")).isin(*STATUSES)}
    said += [say(rows.filter(test), keys, stage, F.concat("at", F.lit(f".{f}")), "invalid_item") for f, test in wrong.items()]
    good = rows
    for test in wrong.values():
        good = good.filter(~test)
    whole = proofs_of(F.col("raw"), F.col("page_url"))
    odd = good.select(*keys, "at", F.posexplode("raw").alias("p_ord", "p"))
    place = F.concat("at", F.lit(".proofs["), F.col("p_ord").cast("string"), F.lit("]"))
    said.append(say(odd.filter(~is_kind(F.col("p"), "OBJECT")), keys, stage, place, "invalid_item"))
    said.append(say(odd.filter(is_kind(F.col("p"), "OBJECT") & ~proof_type(F.col("p")).isin(*PROOF_TYPES)), keys, stage, F.concat(place, F.lit(".type")), "invalid_item"))
    out = good.select("mission_id", F.concat_ws("/", "audit_ord", "c_ord").alias("candidate_id"), "brand", "reference", "page_url", "audit_ord", "ord", F.trim("requirement_id").alias("requirement_id"), "requested_value", F.coalesce("observed_value", F.lit("")).alias("observed_value"), "status", whole.alias("proofs"))
    return out, sanitized(union(said))


def is_limited(status: Column, kind: Column) -> Column:
    """Did a provider refuse a call because of its rate? By HTTP status or the error's name."""
    return F.coalesce(status == 429, F.lit(False)) | F.coalesce(kind.contains("RateLimit"), F.lit(False))


def is_temporary(status: Column, kind: Column) -> Column:
    """May a failed call of a provider go well later: a rate limit, a lost connection, or a server's error?"""
    named = F.exists(F.array(*map(F.lit, ("Timeout", "Connection", "ServiceUnavailable", "InternalServer"))), lambda n: F.coalesce(kind.contains(n), F.lit(False)))
    return is_limited(status, kind) | named | F.coalesce(status.between(500, 599), F.lit(False))


def retry_delay(attempt: Column, asked: Column) -> Column:
    """Seconds before the next call: those of the attempt (from 0), or what the server asks for if that is longer and at
    most LONGEST_DELAY; null after the last attempt."""
    own = F.get(F.array(*map(F.lit, RETRY_DELAYS)), attempt).cast("double")
    return F.when(own.isNotNull() & (asked > 0) & (asked <= LONGEST_DELAY), F.greatest(own, asked)).otherwise(own)
