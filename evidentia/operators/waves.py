"""What an adaptive search does next: which leads get angles or shop queries, whether a wave got on, and budgets of waves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import kernels as k
from evidentia.operators.identity import origin_of
from evidentia.operators.matching import nested_pairs

# Limits of a mission and of a wave.
MOST_WAVES, MOST_QUERIES, PER_WAVE, MOST_PAGES, PAGES_PER_WAVE, ANGLES = 4, 12, 3, 36, 12, 2


def names_lead(query: Column, brand: Column, reference: Column) -> Column:
    """Does a query carry a lead's brand and reference?"""
    return k.udf(lambda q, b, r: k.identity_present(b, q) and k.identity_present(r, q), "boolean")(query, brand, reference)


def angle_counts(leads: DataFrame, sent: DataFrame) -> DataFrame:
    """leads (mission_id, brand_key, reference_key, ...) with `angles`: queries sent for the lead or a nested identity.

    `sent`: mission_id, brand_key, reference_key, n."""
    keys = ["mission_id", "brand_key", "reference_key"]
    sums = nested_pairs(leads.select(*keys).distinct(), sent.select(*keys, "n")).groupBy(*keys).agg(F.sum("n").cast("bigint").alias("angles"))
    return leads.join(sums, keys, "left").withColumn("angles", F.coalesce("angles", F.lit(0).cast("bigint")))


def targeted(leads: DataFrame, sent: DataFrame) -> DataFrame:
    """Leads with fewer than ANGLES queries, in `turn`: the fewest queries first, then by rank."""
    turn = F.row_number().over(Window.partitionBy("mission_id").orderBy("angles", "rank"))
    return angle_counts(leads, sent).filter(F.col("angles") < ANGLES).withColumn("turn", turn)


def for_shops(leads: DataFrame, missions: DataFrame, requirements: DataFrame, previous: DataFrame, domains: list[str]) -> DataFrame:
    """Leads that aren't the origin and miss a `site:` query of a domain, in `turn`: the fewest such queries first.

    `previous`: mission_id, query. Domains are configuration."""
    own = requirements.groupBy("mission_id").agg(F.collect_list(F.struct("requirement_id", "label", "requested_value")).alias("criteria"))
    covers = k.udf(lambda b, r, p, o, c: origin_of(p, o, c).covers(b, r), "boolean")
    rows = leads.join(missions.select("mission_id", "product", "origin_brand"), "mission_id").join(own, "mission_id", "left")
    rows = rows.filter(~covers("brand", "reference", "product", "origin_brand", F.coalesce("criteria", F.array().cast("array<struct<requirement_id:string,label:string,requested_value:string>>")))).select(*leads.columns)
    asked = previous.select("mission_id", F.lower(F.trim(F.regexp_replace("query", r"\s+", " "))).alias("asked")).distinct()
    wanted = rows.withColumn("domain", F.explode(F.array(*map(F.lit, domains)))).withColumn("asked", F.lower(F.concat(F.lit("site:"), "domain", F.lit(" "), "reference")))
    counts = wanted.join(asked, ["mission_id", "asked"]).groupBy("mission_id", "brand", "reference").agg(F.count("*").alias("sent"))
    turn = F.row_number().over(Window.partitionBy("mission_id").orderBy("sent", "rank"))
    out = rows.join(counts, ["mission_id", "brand", "reference"], "left").withColumn("sent", F.coalesce("sent", F.lit(0)))
    return out.filter(F.col("sent") < len(domains)).withColumn("turn", turn)


def progressed(before: DataFrame, after: DataFrame) -> DataFrame:
    """mission_id, progressed: has a lead a proven label that it hadn't, under its own or a nested identity, before?

    Both: mission_id, brand_key, reference_key, label."""
    known = nested_pairs(after, before.select("mission_id", "brand_key", "reference_key", "label"), on=("label",)).select(*after.columns).distinct()
    new = after.join(known, after.columns, "left_anti").select("mission_id").distinct().withColumn("progressed", F.lit(True))
    return after.select("mission_id").distinct().join(new, "mission_id", "left").withColumn("progressed", F.coalesce("progressed", F.lit(False)))


def budgets(done: DataFrame) -> DataFrame:
    """mission_id, wave, queries, pages: what the next wave may spend; missions that may not go on are left out.

    `done`: mission_id, wave, queries, pages so far, progressed."""
    left = done.withColumns({"wave": F.col("wave") + 1, "queries": F.least(F.lit(PER_WAVE), F.lit(MOST_QUERIES) - F.col("queries")), "pages": F.least(F.lit(PAGES_PER_WAVE), F.lit(MOST_PAGES) - F.col("pages"))})
    return left.filter((F.col("wave") <= MOST_WAVES) & (F.col("queries") > 0) & (F.col("pages") > 0)).select("mission_id", "wave", "queries", "pages")
