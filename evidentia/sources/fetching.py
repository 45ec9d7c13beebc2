"""Fetching as rows: attempts, what they say, and which rung comes next. The calls themselves are a provider's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions.urls import url_host
from evidentia.sources.tables import is_blocked

# The rungs of fetching in order, and how much of messages is kept.
RUNGS, DOCUMENT_RUNG, MESSAGE, REASON = ("http", "stealth", "camoufox"), "pdf", 200, 120


def short(c: Column, most: int) -> Column:
    """A message in one line, cut."""
    return F.left(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), F.lit(most))


def described(attempts: DataFrame) -> DataFrame:
    """attempts (mode, outcome, status, content_type, html_length, text_length, error_type, error_message, duration_ms) with
    `description`."""
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    with_status = lambda text: F.concat(F.when(F.col("status").isNotNull(), F.concat(F.lit("HTTP "), F.col("status").cast("string"), F.lit(", "))).otherwise(""), text)
    detail = (
        F.when(F.col("outcome") == "exception", F.concat_ws(": ", "error_type", F.nullif(short(F.col("error_message"), MESSAGE), F.lit(""))))
        .when(F.col("outcome") == "unusable_status", F.concat(F.lit("HTTP "), number("status"), F.lit(", type "), F.coalesce(F.nullif(F.col("content_type"), F.lit("")), F.lit("unknown"))))
        .when(F.col("outcome") == "invalid_status", "unreadable HTTP status")
        .when(F.col("outcome") == "empty_content", with_status(F.concat(number("html_length"), F.lit(" characters of HTML, "), number("text_length"), F.lit(" of use"))))
        .otherwise(with_status(F.concat(number("text_length"), F.lit(" characters of use"))))
    )
    return attempts.withColumn("description", F.concat("mode", F.lit("="), "outcome", F.lit(" ["), detail, F.lit("] in "), number("duration_ms"), F.lit(" ms")))


def next_rungs(requests: DataFrame, attempts: DataFrame, third: bool = True) -> DataFrame:
    """url, rung of requests that are neither answered nor given up: a document's address has a rung of its own; others go up
    the rungs, the third only after a refusal of robots, and only on hosts that haven't refused it.

    `attempts`: url, ord, mode, outcome, status. Addresses that aren't http have no rung."""
    last = Window.partitionBy("url").orderBy(F.desc("ord"))
    state = attempts.groupBy("url").agg(F.max((F.col("outcome") == "success").cast("int")).alias("done"), F.max(is_blocked(F.col("status")).cast("int")).alias("blocked"))
    newest = attempts.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select("url", "mode")
    refused = attempts.filter((F.col("mode") == RUNGS[2]) & (F.col("outcome") != "success")).select(url_host(F.col("url")).alias("host")).distinct().withColumn("refused", F.lit(True))
    rows = requests.select("url").distinct().filter(F.col("url").rlike("(?i)^https?://")).join(state, "url", "left").join(newest, "url", "left").withColumn("host", url_host(F.col("url"))).join(refused, "host", "left")
    document = F.lower("url").rlike(r"^[^?#]*\.pdf([?#]|$)")
    rung = F.when(document, F.when(F.col("mode").isNull(), DOCUMENT_RUNG)).when(F.col("mode").isNull(), RUNGS[0]).when(F.col("mode") == RUNGS[0], RUNGS[1])
    rung = rung if not third else F.coalesce(rung, F.when(~document & (F.col("mode") == RUNGS[1]) & (F.col("blocked") == 1) & F.col("refused").isNull(), RUNGS[2]))
    return rows.filter(F.coalesce("done", F.lit(0)) == 0).select("url", rung.alias("rung")).filter("rung IS NOT NULL")


def unresponsive_reason(payload: Column, engine: Column) -> Column:
    """Why a search engine didn't answer, from the list of pairs in a payload's JSON; empty if it isn't there."""
    pairs = F.from_json(F.get_json_object(payload, "$.unresponsive_engines"), "array<array<string>>")
    found = F.filter(pairs, lambda p: (F.size(p) >= 2) & (F.lower(p[0]) == F.lower(engine)))
    return short(F.get(found, F.lit(0))[1], REASON)
