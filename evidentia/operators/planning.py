"""Deterministic search queries of a mission: three angles over its requirements, family queries, targeted and site queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import kernels as k
from evidentia.functions import scan
from evidentia.operators.hits import tidy_query, without_origin
from evidentia.operators.identity import origin_of

PER_WAVE, MOST_WORDS, ANGLES_PER_LEAD = 3, 14, 2
# Angles of general queries and of targeted ones; words of labels that name an identity.
ANGLES = ("fiche produit", "caractéristiques techniques", "documentation constructeur pdf")
LEAD_ANGLES = ("fiche technique", "datasheet")
IDENTITY_WORDS = frozenset("reference marque gamme brand modele model".split())


def own_codes(product: str | None) -> list[str]:
    """The product's codes of two parts or more, with letters and digits."""
    return [c for c, _, _ in scan.codes(product or "", "-_") if scan.mixed(c) and not c.isalnum()]


def family(product: str | None) -> str:
    """The part before the first separator of the product's longest code, if it has four characters and a digit."""
    codes = own_codes(product)
    head = re.split("[-_]", max(codes, key=len))[0] if codes else ""
    return head if len(head) >= 4 and re.search(r"\d", head) else ""


def suffixes(product: str | None) -> list[str]:
    """Telling codes behind separators of the product's codes, the longest first."""
    parts = {p.casefold() for code in own_codes(product) for p in re.split("[-_]", code)[1:]}
    return sorted((p for p in parts if len(p) >= 4 and re.search("[a-z]", p) and re.search(r"\d", p)), key=lambda p: (-len(p), p))


def with_family(query: str, product: str) -> str:
    """A query with the family in the place of the product's own codes."""
    for code in dict.fromkeys(own_codes(product)) if family(product) else ():
        query = re.sub(r"(?<![A-Za-z0-9])" + r"[\W_]*".join(re.findall("[A-Za-z0-9]+", code)) + r"(?![A-Za-z0-9])", family(product), query, flags=re.I)
    return tidy_query(query)


def semantic_value(requested: str, product: str) -> str:
    """`code: meaning` asks for the meaning where the code is a suffix of the origin's own."""
    m = re.match(r"\s*([A-Za-z0-9_-]+)\s*:\s*(\S.*)$", requested or "")
    return m[2].strip() if m and m[1].casefold() in suffixes(product) else requested


def branded(query: str, brand: str) -> str:
    return query if not brand or brand.casefold() in query.casefold() else f"{brand} {query}"


def core(product: str, origin_brand: str, criteria: list, missing: set[str], offset: int) -> str:
    """The product without its values and origin, and three or four criteria from an offset on, open and critical ones first."""
    usable = [c for c in criteria if not IDENTITY_WORDS & set(re.findall("[a-z]+", k.unaccented(f"{c['requirement_id']} {c['label']}".casefold())))]
    ordered = sorted(usable, key=lambda c: (k.collapse(c["label"]) not in missing, not c["critical"]))
    chosen = ordered[offset : offset + (4 if offset else 3)]
    chosen = (chosen[::-1] if offset else chosen) or ordered[:3]
    text = without_origin(product, origin_brand)
    for value in sorted((c["requested_value"].strip() for c in criteria), key=len, reverse=True):
        if len(k.folded_key(value)) >= 3:
            text = re.sub(re.escape(value), " ", text, flags=re.I)
    origin, anchor = origin_of(product, origin_brand, criteria), family(product)
    words = [w if not (origin.covers(bare := w.strip(" ,;:.()[]{}"), "") or k.identity_key(bare) in origin.codes) else anchor for w in text.split()]
    return tidy_query((tidy_query(" ".join(filter(None, words))) or "produit industriel") + " " + " ".join(f"{c['label']} {c['requested_value']}" for c in chosen))


def fallback_queries(product: str, origin_brand: str, target: str, criteria: list, missing: list, previous: list) -> list[str]:
    """Three new queries; where one was sent before, a numbered variant."""
    taken, out = {k.collapse(q) for q in previous or ()}, []
    rows = [c.asDict() if hasattr(c, "asDict") else c for c in criteria]
    for n, angle in enumerate(ANGLES):
        text = core(product or "", origin_brand or "", rows, {k.collapse(m) for m in missing or ()}, n * 3)
        for variant in range(101):
            query = without_origin(tidy_query(f"{angle}{f' variante{variant}' if variant else ''} {text}"), origin_brand or "")
            query = branded(query, (target or "").strip())
            if query and k.collapse(query) not in taken:
                break
        taken.add(k.collapse(query))
        out.append(query)
    return out


def valid_plan(queries: list | None, previous: list | None) -> bool:
    """Exactly three queries, new, distinct, and not too long."""
    keys = [k.collapse(q) for q in queries or ()]
    return len(keys) == PER_WAVE == len(set(keys) - {""} - {k.collapse(q) for q in previous or ()}) and all(len(q.split()) <= MOST_WORDS for q in queries)


def plan(missions: DataFrame, requirements: DataFrame) -> DataFrame:
    """mission_id, position, query, strategy: a mission's planned queries if they are valid, else the deterministic ones.

    `missions` also has missing, previous and planned (arrays; planned may be null)."""
    per = requirements.groupBy("mission_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "requirement_id", "label", "requested_value", "critical"))), lambda x: x).alias("criteria"))
    rows = missions.join(per, "mission_id")
    ok = k.udf(valid_plan, "boolean")("planned", "previous")
    own = k.udf(fallback_queries, "array<string>")("product", "origin_brand", "target_brand", "criteria", "missing", "previous")
    return rows.withColumn("_ok", ok).select("mission_id", F.posexplode(F.when(F.col("_ok"), F.col("planned")).otherwise(own)).alias("position", "query"), F.when(F.col("_ok"), "model").otherwise("fallback").alias("strategy"))


def targeted_queries(leads: DataFrame, previous: DataFrame) -> DataFrame:
    """Up to PER_WAVE new queries a mission over its leads (mission_id, brand, reference, rank, sent): a round of first
    angles, then of second ones; leads with fewer queries sent before come first."""
    open_ = leads.filter(F.col("sent") < ANGLES_PER_LEAD).select("*", F.posexplode(F.array(*map(F.lit, LEAD_ANGLES))).alias("nth", "angle"))
    rows = open_.withColumn("query", F.concat_ws(" ", "brand", "reference", "angle")).join(previous.select("mission_id", "query"), ["mission_id", "query"], "left_anti")
    order = Window.partitionBy("mission_id").orderBy("nth", "sent", "rank")
    return rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= PER_WAVE).select("mission_id", "position", "query", "brand", "reference")


def site_queries(leads: DataFrame, domains: list[str], previous: DataFrame) -> DataFrame:
    """`site:domain reference` of each lead and distributor domain (configuration) that wasn't sent before."""
    rows = leads.withColumn("domain", F.explode(F.array(*map(F.lit, domains)).cast("array<string>")))
    rows = rows.withColumn("query", F.concat(F.lit("site:"), F.col("domain"), F.lit(" "), F.col("reference"))).withColumn("_q", F.lower("query"))
    return rows.join(previous.select("mission_id", F.lower("query").alias("_q")), ["mission_id", "_q"], "left_anti").select("mission_id", "query", "brand", "reference", "domain").distinct()
