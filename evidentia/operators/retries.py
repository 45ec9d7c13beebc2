"""Calls of providers as an event log: what follows from the attempts of a request so far, and which requests go out again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.operators.payloads import RETRY_DELAYS, is_limited, is_temporary, retry_delay

STATES = ("succeeded", "failed", "exhausted", "retry")


def numbered(events: DataFrame, *key: str) -> DataFrame:
    """Events (key, at, ok, status, kind, asked) with attempt, from 0, by their time; what follows a success or an error that
    no repetition mends belongs to no request and is left out."""
    order = Window.partitionBy(*key).orderBy("at", F.desc("ok"), "status", "kind", "asked")
    ends = F.coalesce("ok", F.lit(False)) | ~is_temporary(F.col("status"), F.col("kind"))
    before = F.coalesce(F.max(ends.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = events.withColumns({"attempt": F.row_number().over(order) - 1, "_ended": before})
    return rows.filter((F.col("_ended") == 0) & (F.col("attempt") <= len(RETRY_DELAYS))).drop("_ended")


def outcomes(events: DataFrame, *key: str) -> DataFrame:
    """key, state, attempts, waited (seconds between attempts, as planned), delay (before the next one), due: a row a request.

    A success and an error that isn't temporary end a request; a temporary one is repeated as long as there are delays."""
    rows = numbered(events, *key).withColumn("delay", F.when(~F.coalesce("ok", F.lit(False)) & is_temporary(F.col("status"), F.col("kind")), retry_delay(F.col("attempt"), F.col("asked"))))
    last = F.max_by(F.struct("ok", "at", "delay", "status", "kind"), "attempt").alias("l")
    per = rows.groupBy(*key).agg(F.count("*").cast("int").alias("attempts"), last, F.sum("delay").alias("_all"), F.max(is_limited(F.col("status"), F.col("kind")).cast("int")).alias("_limited"))
    return per.select(*key, state_of().alias("state"), "attempts", (F.coalesce("_all", F.lit(0.0)) - F.coalesce("l.delay", F.lit(0.0))).alias("waited"), F.col("l.delay").alias("delay"), (F.col("l.at") + F.make_dt_interval(secs=F.col("l.delay"))).alias("due"), (F.col("_limited") == 1).alias("limited"))


def state_of() -> Column:
    temporary = is_temporary(F.col("l.status"), F.col("l.kind"))
    return F.when(F.coalesce("l.ok", F.lit(False)), STATES[0]).when(~temporary, STATES[1]).when(F.col("l.delay").isNull(), STATES[2]).otherwise(STATES[3])


def due(requests: DataFrame, told: DataFrame, now: Column, *key: str) -> DataFrame:
    """The requests that were never sent, and those whose next attempt is due; `told`: outcomes()."""
    settled = told.filter((F.col("state") != "retry") | (F.col("due") > now)).select(*key)
    return requests.join(settled, list(key), "left_anti")


def repaired(ask, requests: DataFrame, good, *key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, broken first answers, broken second answers): what `ask` tells of `requests`, and of those whose answer isn't
    `good` (a condition) a second time, once. An answer that is broken twice stays."""
    from evidentia.runtime import cut

    first = cut(ask(requests))
    bad = first.filter(~F.coalesce(good, F.lit(False)))
    second = cut(ask(requests.join(bad.select(*key).distinct(), list(key), "left_semi")))
    kept = first.join(second.select(*key).distinct(), list(key), "left_anti")
    return kept.unionByName(second), bad, second.filter(~F.coalesce(good, F.lit(False)))
