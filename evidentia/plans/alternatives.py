"""The plain form of results: one alternative a row, whether it may be offered, and the best of each request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Statuses that propose something, and the least relevance of one with deviations.
PROPOSED, LEAST_RELEVANCE = ("complete", "avec_adaptation"), 75


def official_sources(sources: Column) -> Column:
    return F.size(F.filter(sources, lambda s: s["type"] == "web_officiel"))


def usable(least: int = LEAST_RELEVANCE) -> Column:
    """Proposed, named, with sources, and either complete without a deviation or relevant enough."""
    stated = F.col("status").isin(*PROPOSED) & (F.trim(F.coalesce("alternative", F.lit(""))) != "") & (F.size("sources") > 0)
    return stated & (((F.col("status") == "complete") & (F.size("deviations") == 0)) | (F.col("relevance") >= least))


def best(results: DataFrame, least: int = LEAST_RELEVANCE) -> DataFrame:
    """The usable result of each request with fewest deviations, then by relevance, official sources, limits and sources."""
    order = Window.partitionBy("request_id").orderBy(F.size("deviations"), F.desc("relevance"), F.desc(official_sources(F.col("sources"))), F.size("limits"), F.desc(F.size("sources")), "ord")
    return results.filter(usable(least)).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
