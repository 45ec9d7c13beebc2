"""Rejected candidates that are near: verdict, targeted research tasks, and their selection for a budget. Native arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import kernels as k

# Words of a label that name the product's category, or an identity; and other search terms of labels.
CATEGORY = ("type de produit", "categorie", "famille de produit", "nature du produit", "usage", "product type", "category")
IDENTITY = "fabricant manufacturer marque brand reference mpn famille family gamme serie series modele model"
SEARCH_TERMS = {"tension de bobine": "coil voltage", "tension de commande": "control voltage", "courant nominal": "rated current", "nombre de poles": "number of poles", "contacts principaux": "main contacts"}
PATHS = ("INCOMPLETE", "ESTABLISHED", "DIRECTIONAL")

phrase = k.udf(k.phrase_key, "string")


def is_identity_label(label: Column) -> Column:
    key = phrase(label)
    return F.arrays_overlap(F.split(key, " "), F.array(*map(F.lit, IDENTITY.split()))) | F.contains(key, F.lit("part number"))


def is_category_label(label: Column) -> Column:
    text = F.lower(F.trim(label))
    return F.exists(F.array(*map(F.lit, CATEGORY)), lambda c: F.contains(text, c))


def family_of(reference: Column) -> Column:
    """A reference up to its first separator, if that has three characters or more."""
    value = F.trim(F.coalesce(reference, F.lit("")))
    head = F.regexp_extract(value, r"^([^-_/\s]*)", 1)
    return F.when(F.length(head) >= 3, head).otherwise(value)


def search_family(reference: Column, urls: Column) -> Column:
    """The family, or for a code without separators the common part of another designation in the URLs that prove it."""
    value, family = F.trim(F.coalesce(reference, F.lit(""))), family_of(reference)
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    read = F.flatten(F.transform(urls, lambda u: F.regexp_extract_all(F.lower(F.try_url_decode(u)), F.lit(r"[a-z0-9]+(?:[-_][a-z0-9]+)+"), F.lit(0))))
    usable = F.filter(read, lambda d: d.rlike("[a-z]") & d.rlike("[0-9]") & (key(d) != key(value)))
    heads = F.filter(F.transform(usable, lambda d: F.regexp_extract(d, r"^(.*)[-_][a-z0-9]+$", 1)), lambda h: F.length(h) >= 5)
    return F.when((value == "") | (family != value) | (F.size(heads) == 0), family).otherwise(F.element_at(heads, 1))


def assess(evaluations: DataFrame, requirements: DataFrame) -> DataFrame:
    """mission_id, candidate_id, near_miss, reason, path, research_criteria ... of candidates that aren't eligible.

    `evaluations` also has identity and family. Requirements are a mission's few; they are joined as one array."""
    req = requirements.select("mission_id", "ord", "requirement_id", "label", "requested_value", is_identity_label(F.col("label")).alias("is_identity"), is_category_label(F.col("label")).alias("is_category"))
    per = req.groupBy("mission_id").agg(F.array_sort(F.collect_list(F.struct("ord", "requirement_id", "label", "requested_value", "is_identity", "is_category"))).alias("reqs"))
    rows = evaluations.filter(~F.col("eligible")).join(per, "mission_id")

    def of(labels: str) -> Column:
        """Requirements of the labels, in the labels' order; of equal labels the last requirement."""
        return F.transform(F.col(labels), lambda x: F.element_at(F.filter("reqs", lambda r: r["label"] == x), -1))

    blockers = F.filter(of("incompatible_criteria"), lambda r: ~r["is_identity"])
    unproven = F.array_distinct(F.concat(of("not_proven_criteria"), of("unverified_criteria")))
    missing = F.filter(unproven, lambda r: ~r["is_identity"] & ~r["is_category"] & (F.trim(r["requested_value"]) != ""))
    rows = rows.withColumn("blockers", blockers).withColumn("missing", missing).withColumn("n_proven", F.size("proven_criteria"))
    n_bad, none = F.size("blockers"), (F.trim(F.coalesce("identity", F.lit(""))) == "") & (F.trim(F.coalesce("family", F.lit(""))) == "")
    incomplete = (F.col("n_proven") >= 2) & (F.size("missing") > 0)
    path = F.when(none, None).when(n_bad == 0, F.when(incomplete, "INCOMPLETE")).when(F.exists("blockers", lambda r: r["is_category"]) | F.exists("blockers", lambda r: F.trim(r["requested_value"]) == "") | (n_bad > 2), None).when(F.col("n_proven") >= 2, "ESTABLISHED").when(n_bad == 1, "DIRECTIONAL")
    ids = lambda c: F.transform(F.col(c), lambda r: r["requirement_id"])
    refusal = F.when(none, "NOT_ELIGIBLE_NO_CREDIBLE_IDENTITY").when(n_bad == 0, "NOT_ELIGIBLE_NO_PROVEN_INCOMPATIBILITY").when(F.exists("blockers", lambda r: r["is_category"]), "NOT_ELIGIBLE_WRONG_PRODUCT_CATEGORY").when(F.exists("blockers", lambda r: F.trim(r["requested_value"]) == ""), "NOT_ELIGIBLE_NO_TARGET_VALUE").when(n_bad > 2, "NOT_ELIGIBLE_TOO_MANY_BLOCKERS").otherwise("NOT_ELIGIBLE_DIRECTIONAL_REQUIRES_SINGLE_BLOCKER")
    rows = rows.withColumn("path", path)
    reason = F.when(F.col("path") == "INCOMPLETE", F.concat(F.lit("NEAR_MISS_UNVERIFIED_CRITERION:"), F.array_join(ids("missing"), ","))).when(F.col("path").isNotNull(), F.concat(F.lit("NEAR_MISS_BLOCKING_CRITERION:"), F.array_join(ids("blockers"), ","))).otherwise(refusal)
    research = F.when(F.col("path") == "INCOMPLETE", F.col("missing")).when(F.col("path").isNotNull(), F.col("blockers")).otherwise(F.array().cast("array<struct<ord:int,requirement_id:string,label:string,requested_value:string,is_identity:boolean,is_category:boolean>>"))
    return rows.select("mission_id", "candidate_id", "identity", "family", F.col("path").isNotNull().alias("near_miss"), reason.alias("reason"), "path", "n_proven", ids("blockers").alias("blocking_criteria"), ids("missing").alias("missing_criteria"), n_bad.alias("n_blockers"), research.alias("research"))


def search_queries(identity: Column, family: Column, label: Column, target: Column) -> Column:
    """`anchor term "target"`: family with the label, identity with its other term; a sole anchor takes all terms."""
    terms = F.create_map(*[F.lit(x) for pair in SEARCH_TERMS.items() for x in pair])
    names = F.array_compact(F.array(F.trim(label), terms[phrase(label)]))
    anchors = F.filter(F.array(F.trim(F.coalesce(family, F.lit(""))), F.trim(F.coalesce(identity, F.lit("")))), lambda a: a != "")
    pairs = F.transform(names, lambda t, i: F.concat(F.when(F.size(anchors) == 1, F.element_at(anchors, 1)).otherwise(F.get(anchors, i)), F.lit(" "), t, F.lit(' "'), F.trim(target), F.lit('"')))
    return F.when((F.trim(target) == "") | (F.size(anchors) == 0), F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(pairs)))


def targeted_tasks(assessed: DataFrame) -> DataFrame:
    """One task per research criterion of a near candidate, with queries, signature and a dense priority per mission."""
    rows = assessed.filter("near_miss").select("*", F.explode("research").alias("r"))
    anchor = F.when(F.trim(F.coalesce("family", F.lit(""))) != "", F.col("family")).otherwise(F.col("identity"))
    rows = rows.select("mission_id", "candidate_id", "identity", "family", "path", "n_proven", "n_blockers", F.col("r.requirement_id").alias("criterion"), F.trim("r.requested_value").alias("target_value"), search_queries(F.col("identity"), F.col("family"), F.col("r.label"), F.col("r.requested_value")).alias("queries"), F.concat_ws("|", phrase(anchor), phrase("r.requirement_id"), phrase("r.requested_value")).alias("signature"))
    order = Window.partitionBy("mission_id").orderBy(path_rank(), F.desc("n_proven"), "n_blockers", "signature", "candidate_id")
    return rows.filter(F.size("queries") > 0).withColumn("priority", F.row_number().over(order) - 1)


def path_rank() -> Column:
    return F.array_position(F.array(*map(F.lit, PATHS)), F.col("path"))


def select_queries(tasks: DataFrame, budgets: DataFrame) -> DataFrame:
    """mission_id, query, position, signature: the queries that a mission's budget allows.

    `budgets`: mission_id, budget, seen_signatures. Seen signatures and repeats fall out. With a budget of two or more and
    other paths present, the best DIRECTIONAL task comes first; then all first queries before all second ones."""
    rows = tasks.join(budgets, "mission_id").filter(~F.array_contains(F.coalesce("seen_signatures", F.array().cast("array<string>")), F.col("signature")))
    first = Window.partitionBy("mission_id", "signature").orderBy("priority")
    rows = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    mission = Window.partitionBy("mission_id")
    directional = F.col("path") == "DIRECTIONAL"
    rows = rows.withColumn("_best", F.min(F.when(directional, F.col("priority"))).over(mission)).withColumn("_others", F.max((~directional).cast("int")).over(mission))
    rows = rows.withColumn("reserved", directional & (F.col("priority") == F.col("_best")) & (F.col("_others") == 1) & (F.col("budget") >= 2))
    queries = rows.select("mission_id", "budget", "reserved", "priority", "signature", F.posexplode("queries").alias("nth", "query"))
    order = Window.partitionBy("mission_id").orderBy((F.col("nth") > 0).cast("int"), (~F.col("reserved")).cast("int"), "priority", "nth")
    return queries.withColumn("position", F.row_number().over(order)).filter("position <= budget").select("mission_id", "query", "position", "signature")
