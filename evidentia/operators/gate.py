"""Which fetched pages go on to be read: literal identifiers, list pages, and the counters of verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.urls import is_list_page

# What shows that a site refused to be read; and the least length of a page that says something.
REFUSALS = ("just a moment", "checking your browser", "enable javascript and cookies", "vérification de votre navigateur", "access denied", "attention required", "captcha", "ddos protection")
LEAST_LENGTH = 1500


def mode_for(analysis: Column, declared: Column | None = None) -> Column:
    chosen = F.when(analysis == "discovery", "PRODUCT_DISCOVERY").otherwise("PRODUCT_EVIDENCE")
    return chosen if declared is None else F.when((analysis == "targeted") & declared.isNotNull(), declared).otherwise(chosen)


def literal_matches(values: Column, content: Column) -> Column:
    """The values that stand in the content as they are, but for case; no separators are freed."""
    text = F.lower(F.coalesce(content, F.lit("")))
    return F.filter(values, lambda v: (F.trim(v) != "") & F.contains(text, F.lower(F.trim(v))))


def qualify(pages: DataFrame) -> DataFrame:
    """pages (url, content, mode, expected, brands: arrays) with accepted, reason, matched and content_length."""
    empty = F.array().cast("array<string>")
    content = F.coalesce("content", F.lit(""))
    expected = F.filter(F.coalesce("expected", empty), lambda v: F.trim(v) != "")
    found, makers = literal_matches(expected, content), literal_matches(F.coalesce("brands", empty), content)
    evidence = F.when(is_list_page(F.col("url")), "REJECTED_FOR_PRODUCT_EVIDENCE").when(F.size(expected) == 0, "NOT_READY_FOR_PRODUCT_EVIDENCE").when(F.size(found) == 0, "REJECTED_FOR_PRODUCT_EVIDENCE")
    reason = F.when(F.trim(content) == "", "REJECTED_EMPTY_CONTENT").when(F.col("mode") == "PRODUCT_EVIDENCE", F.coalesce(evidence, F.lit("ACCEPTED"))).when((F.col("mode") == "DOMAIN_CONFIRMATION") & (F.size(makers) == 0), "REJECTED_FOR_DOMAIN_CONFIRMATION").otherwise("ACCEPTED")
    matched = F.when(F.col("mode") == "DOMAIN_CONFIRMATION", makers).otherwise(found)
    return pages.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "ACCEPTED").withColumn("matched", F.when(F.col("accepted"), matched).otherwise(empty)).withColumn("content_length", F.length(content))


def counters(verdicts: DataFrame) -> DataFrame:
    """Per mission: fetched = analyzed + rejected + not ready."""
    not_ready = F.col("reason") == "NOT_READY_FOR_PRODUCT_EVIDENCE"
    return verdicts.groupBy("mission_id").agg(F.count("*").alias("pages_fetched"), F.count_if("accepted").alias("pages_analyzed"), F.count_if(~F.col("accepted") & ~not_ready).alias("pages_rejected_by_gate"), F.count_if(not_ready).alias("pages_not_ready_for_evidence"))


def page_diagnosis(content: Column) -> Column:
    """Why a page can't be used: a refusal, or hardly any text; empty if it can."""
    text = F.lower(F.coalesce(content, F.lit("")))
    marks = F.filter(F.array(*map(F.lit, REFUSALS)), lambda m: F.contains(text, m))
    size = F.length(F.trim(text))
    return F.when(F.size(marks) > 0, F.concat(F.lit("protected: "), F.get(marks, F.lit(0)))).when(size < LEAST_LENGTH, F.concat(F.lit("nearly empty: "), size.cast("string"))).otherwise("")
