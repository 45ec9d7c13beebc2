"""Other inputs and outputs: datasheets, the page cache, brand knowledge, offline search hits and pages."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import kernels as k
from evidentia.functions.urls import canonical_url, url_host
from evidentia.operators.identity import Brands

LEAST_DATASHEET, CACHE_VERSION, CACHE_MODES = 20, 1, ("http", "stealth", "camoufox", "pdf")


def read_datasheets(spark: SparkSession, path: str) -> DataFrame:
    """path, text, status (ok, empty, too_short, pdf: to be read by a provider) of each file; UTF-8, else Windows-1252."""
    rows = spark.read.format("binaryFile").load(path)
    pdf = F.lower("path").endswith(".pdf")
    rows = rows.select("path", F.when(~pdf, k.udf(k.decode_ladder, "string")("content")).alias("text"))
    size = F.length(F.trim(F.coalesce("text", F.lit(""))))
    return rows.withColumn("status", F.when(F.lower("path").endswith(".pdf"), "pdf").when(size == 0, "empty").when(size < LEAST_DATASHEET, "too_short").otherwise("ok"))


def datasheet_text(entries: DataFrame) -> DataFrame:
    """Entries (mission_id, brand, reference, name, characteristics map, text) as datasheet text and the brand sought."""
    line = lambda label, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(f"{label}: "), F.trim(c)))
    facts = F.array_join(F.transform(F.filter(F.map_entries(F.coalesce("characteristics", F.create_map().cast("map<string,string>"))), lambda e: F.trim(e["value"]) != ""), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return entries.withColumn("datasheet", F.concat_ws("\n", line("Brand", F.col("brand")), line("Reference", F.col("reference")), line("Product", F.col("name")), F.nullif(facts, F.lit("")), F.nullif(F.trim(F.coalesce("text", F.lit(""))), F.lit(""))))


def sought_brand(open_mode: Column, targets: Column) -> Column:
    """No brand in open search, else the first target with text."""
    return F.when(~open_mode, F.get(F.filter(targets, lambda t: F.trim(t) != ""), F.lit(0)))


def cache_key(url: Column) -> Column:
    """The canonical URL of an http address with a host, hashed; null for others, which aren't cached."""
    canonical = canonical_url(url)
    return F.when(canonical.rlike("^https?://[^/]") & (url_host(canonical) != ""), F.sha2(canonical, 256))


def cached(requests: DataFrame, cache: DataFrame, now: Column, ttl: str) -> tuple[DataFrame, DataFrame]:
    """Requests (url) that the cache answers, and those that it doesn't.

    A cached row counts if its version and mode are known, it has content, and it is no older than `ttl` (an interval) and
    not from the future. The latest of equal keys counts; a note tells that the page comes from the cache."""
    good = (F.col("version") == CACHE_VERSION) & F.col("mode").isin(*CACHE_MODES) & (F.trim(F.coalesce("content", F.lit(""))) != "") & F.col("title").isNotNull() & (F.col("fetched_at") <= now) & (F.col("fetched_at") >= now - F.expr(f"INTERVAL {ttl}"))
    last = Window.partitionBy("key").orderBy(F.desc("fetched_at"))
    usable = cache.filter(good).withColumn("_n", F.row_number().over(last)).filter("_n = 1").select("key", F.col("url").alias("cached_url"), "title", "content", "mode", "fetched_at", F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.array(F.concat(F.lit("from the page cache, fetched at "), F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")))).alias("warnings"))
    keyed = requests.withColumn("key", cache_key(F.col("url")))
    return keyed.join(usable, "key").drop("key"), keyed.join(usable, "key", "left_anti").drop("key")


def to_cache(pages: DataFrame, now: Column) -> DataFrame:
    """Rows for the cache: successes with a key, one for each key."""
    rows = pages.filter(F.trim(F.coalesce("content", F.lit(""))) != "").withColumn("key", cache_key(F.col("url"))).filter("key IS NOT NULL")
    return rows.dropDuplicates(["key"]).select("key", "url", F.coalesce("title", F.lit("")).alias("title"), "content", "mode", F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"), F.lit(CACHE_VERSION).alias("version"), now.alias("fetched_at"))


def read_brands(path: str | None) -> Brands:
    """Brand knowledge from a JSON file of official domains and canonical aliases, keyed by words; no file is no knowledge."""
    if not path:
        return Brands()
    with open(path, encoding="utf-8") as f:
        data = json.load(f)

    def table(name: str) -> dict[frozenset[str], frozenset[str]]:
        raw = data.get(name) or {}
        if not isinstance(raw, dict):
            raise ValueError(f"{name} must be an object")
        out = {}
        for key, values in raw.items():
            values = [values] if isinstance(values, str) else values
            if not isinstance(values, list):
                raise ValueError(f"{name}[{key!r}] must be a list of strings")
            if words := frozenset(key.casefold().split()):
                out[words] = frozenset(v.casefold().strip() for v in map(str, values) if v.strip())
        return out

    return Brands(table("domaines_officiels"), table("alias_canoniques"))


def classify_response(status: Column, content_type: Column, url: Column, text_length: Column) -> Column:
    """What a fetched response is: invalid_status, unusable_status, pdf, empty_content or success."""
    kind = F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    return F.when(status.isNull(), "invalid_status").when(~status.between(200, 299), "unusable_status").when((kind == "application/pdf") | F.lower(url).rlike(r"\.pdf(\?|#|$)"), "pdf").when(F.coalesce(text_length, F.lit(0)) < 100, "empty_content").otherwise("success")


def is_blocked(status: Column) -> Column:
    """Statuses of protection against robots, not of a missing page."""
    return F.coalesce(status, F.lit(0)).isin(403, 429, 503)
