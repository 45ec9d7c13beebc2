"""Adaptive research: waves of queries, pages and audits over all missions at once, with providers for what needs a network.

A wave is a plan over tables; between waves only whether any mission goes on comes to the driver. A provider gets a table and
gives one, and tells failures in rows: a page without content, an answer without JSON, which is asked for once more.

A mission's registry of leads is a table that each wave adds its new documents to: hits and pages of a discovery, then what
their audits propose. As long as a lead has had few queries the next wave is targeted: it asks for leads, and for leads at
shops, and only candidates that were asked for are read on its pages. What near misses lack is asked for first. A targeted
wave that proves nothing new is followed by a discovery."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import kernels as k
from evidentia.functions.urls import canonical_url
from evidentia.operators import evidence, gate, hits, identity, leads, near_miss, payloads, planning, reaudit, retries, waves
from evidentia.operators.identity import Brands
from evidentia.runtime import cut

Provider = Callable[[DataFrame], DataFrame]
TARGETED_LEADS, NEAR_MISS_QUERIES = 4, 3
STRINGS, KEYS = "array<string>", "array<struct<brand_key:string,reference_key:string>>"
IDENTITY = ["mission_id", "brand_key", "reference_key"]


@dataclass(frozen=True)
class Providers:
    search: Provider  # mission_id, query_ord, query -> the same with rank, url, title, snippet
    fetch: Provider  # mission_id, url -> the same with title, content (null or blank where fetching failed)
    audit: Provider  # mission_id, audit_ord, page_url, title, content, mode, declared -> mission_id, audit_ord, page_url, answer
    hint: Provider | None = None  # mission_id, hit_ord, url, title, snippet -> mission_id, hit_ord, brand, reference


@dataclass(frozen=True)
class Outcome:
    evaluations: DataFrame  # of the last wave
    results: DataFrame  # mission_id, status, final_state, stop_reason
    pages: DataFrame  # with wave
    verdicts: DataFrame  # of the gate
    diagnostics: DataFrame  # of answers
    waves: DataFrame  # mission_id, wave, mode, sent, queries, pages (so far)
    queries: DataFrame  # mission_id, wave, query_ord, query, kind, keys
    leads: DataFrame  # the registries
    refused: DataFrame  # mission_id, brand, reference, reason, url


def judged(criteria: DataFrame, requirements: DataFrame, missions: DataFrame, pages: DataFrame, brands: Brands) -> tuple[DataFrame, DataFrame]:
    """(criteria, evaluations) of all audits so far: validated, merged, looked at again on all pages, and scored."""
    checked = cut(evidence.validate(criteria, requirements, pages))
    merged = cut(evidence.merge(checked))
    for _ in range(2):  # the first pass can only take an incompatibility back
        merged = cut(reaudit.reaudit(merged, requirements, missions, pages, brands).drop("reaudited"))
    valid = cut(evidence.validate(merged, requirements, pages))
    return valid, cut(evidence.evaluate(valid, requirements, missions, pages, brands))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


class State:
    """What goes from wave to wave, all of it tables by mission."""

    def __init__(self, missions: DataFrame, requirements: DataFrame):
        spark = missions.sparkSession
        none = lambda schema: empty(spark, f"mission_id string, {schema}")
        self.open = missions.select("mission_id", *(F.lit(0).alias(c) for c in ("wave", "queries", "pages")), F.lit(False).alias("forced"), F.lit(0).alias("near"))
        self.registry = empty(spark, f"{leads.LEAD}, rank int")
        self.sent = none("query string")
        self.angles = none("brand_key string, reference_key string, n bigint")
        self.pending = none("position int, query string")
        self.signatures = none("signature string")
        self.audited = none("brand_key string, reference_key string")
        self.reread = none("url string, brand_key string, reference_key string")
        self.proven = none("brand_key string, reference_key string, label string")
        self.missing = requirements.groupBy("mission_id").agg(labels(F.struct("ord", "label")).alias("missing"))
        self.pages = none("url string, title string, content string, wave int, page_ord int")
        self.criteria: DataFrame | None = None


def labels(item) -> object:
    return F.transform(F.array_sort(F.collect_list(item)), lambda x: x["label"])


def planned(state: State, missions: DataFrame, requirements: DataFrame, budget: DataFrame, domains: tuple[str, ...]) -> DataFrame:
    """mission_id, query_ord, query, kind (near_miss, lead, shop, general), keys, mode: what a wave sends."""
    active = cut(leads.active(state.registry).join(budget.filter("NOT forced").select("mission_id"), "mission_id"))
    turns = waves.targeted(active, state.angles).filter(F.col("turn") <= TARGETED_LEADS)
    own = planning.targeted_queries(turns.select("mission_id", "brand", "reference", "rank", F.col("angles").alias("sent")), state.sent)
    if domains:
        shops = waves.for_shops(active, missions, requirements, state.sent, list(domains)).filter(F.col("turn") <= TARGETED_LEADS)
        at = F.array_position(F.array(*map(F.lit, domains)), F.col("domain"))
        asked = planning.site_queries(shops, list(domains), state.sent).join(shops.select("mission_id", "brand", "reference", "turn"), ["mission_id", "brand", "reference"])
        shop = asked.withColumn("position", F.row_number().over(Window.partitionBy("mission_id").orderBy(at, "turn")))
        own = hits.interleave(own.withColumn("kind", F.lit("lead")), shop.select(*own.columns, F.lit("shop").alias("kind")))
    else:
        own = own.withColumn("kind", F.lit("lead"))
    keyed = own.join(active.select(*IDENTITY, "brand", "reference"), ["mission_id", "brand", "reference"])
    # one text may be planned for several leads
    grouped = keyed.groupBy("mission_id", "query").agg(F.min("position").alias("position"), F.min_by("kind", "position").alias("kind"), F.array_sort(F.collect_set(F.struct("brand_key", "reference_key"))).alias("keys"))
    grouped = cut(grouped)
    targeted = grouped.select("mission_id").distinct()
    rest = budget.join(targeted, "mission_id", "left_anti").select("mission_id")
    asked = state.sent.groupBy("mission_id").agg(F.collect_set("query").alias("previous"))
    rows = missions.join(rest, "mission_id").join(asked, "mission_id", "left").join(state.missing, "mission_id", "left")
    none = F.array().cast(STRINGS)
    rows = rows.select("mission_id", "product", "origin_brand", "target_brand", F.coalesce("missing", none).alias("missing"), F.coalesce("previous", none).alias("previous"), F.lit(None).cast(STRINGS).alias("planned"))
    general = planning.plan(rows, requirements).select("mission_id", "query", F.col("position").cast("int").alias("position"), F.lit("general").alias("kind"), F.lit(None).cast(KEYS).alias("keys"))
    plan = grouped.select(*general.columns).unionByName(general).withColumn("mode", F.when(F.col("kind") == "general", "discovery").otherwise("targeted"))
    first = F.min("position").over(Window.partitionBy("mission_id"))
    # near misses go first, but a discovery really begins with one query of its own
    plan = plan.withColumn("turn", F.when((F.col("mode") == "discovery") & (F.col("position") == first), 0).otherwise(2))
    near = state.pending.join(plan.select("mission_id", "query"), ["mission_id", "query"], "left_anti").join(plan.select("mission_id", "mode").distinct(), "mission_id")
    plan = plan.unionByName(near.select("mission_id", "query", "position", F.lit("near_miss").alias("kind"), F.lit(None).cast(KEYS).alias("keys"), "mode", F.lit(1).alias("turn")))
    plan = cut(plan.join(state.sent, ["mission_id", "query"], "left_anti"))
    # a lead's queries count against it as they are sent; shops ask beyond that
    each = plan.filter("kind = 'lead'").select("mission_id", "query", "turn", "position", F.explode("keys").alias("key")).select("*", "key.*")
    before = F.row_number().over(Window.partitionBy(*IDENTITY).orderBy("turn", "position")) - 1
    each = waves.angle_counts(each, state.angles).withColumn("before", before).filter(F.col("angles") + F.col("before") < waves.ANGLES)
    allowed = each.groupBy("mission_id", "query").agg(F.array_sort(F.collect_set("key")).alias("allowed"))
    plan = plan.join(allowed, ["mission_id", "query"], "left").filter("kind != 'lead' OR allowed IS NOT NULL").withColumn("keys", F.when(F.col("kind") == "lead", F.col("allowed")).otherwise(F.col("keys"))).drop("allowed")
    place = F.row_number().over(Window.partitionBy("mission_id").orderBy("turn", "position", "query")) - 1
    return plan.withColumn("query_ord", place).join(budget.select("mission_id", F.col("queries").alias("most")), "mission_id").filter("query_ord < most").select("mission_id", "query_ord", "query", "kind", "keys", "mode")


def documents(rows: DataFrame, proposals=None, fallback: bool = True) -> DataFrame:
    """rows (mission_id, ord, url, title, snippets, content, rank) as leads.sightings() reads them."""
    none = F.array().cast("array<struct<brand:string,reference:string>>")
    return rows.select("mission_id", F.col("ord").cast("bigint").alias("ord"), "url", "title", "snippets", "content", F.col("rank").cast("int").alias("rank"), (none if proposals is None else proposals).alias("proposals"), F.lit(fallback).alias("fallback"))


def seen_in_hits(found: DataFrame, missions: DataFrame, requirements: DataFrame, hint: Provider | None) -> DataFrame:
    """Sightings of the hits of a discovery (mission_id, query_ord, rank, url, title, snippet): hints, each checked on the hit
    that it cites; in missions without an accepted hint what the hits themselves say."""
    order = Window.partitionBy("mission_id").orderBy("query_ord", "rank", "url")
    rows = found.withColumn("ord", F.row_number().over(order) - 1).withColumn("snippets", F.when(F.coalesce("snippet", F.lit("")) != "", F.array("snippet")).otherwise(F.array().cast(STRINGS))).withColumn("content", F.lit(""))
    said = None
    if hint is not None:
        same = Window.partitionBy("mission_id", F.lower(F.trim("url"))).orderBy("ord")
        unique = rows.filter(F.trim("url") != "").withColumn("_n", F.row_number().over(same)).filter("_n = 1").drop("_n")
        unique = cut(unique.withColumn("hit_ord", F.row_number().over(Window.partitionBy("mission_id").orderBy("ord")) - 1))
        hints = hint(unique.select("mission_id", "hit_ord", "url", "title", "snippet")).select("mission_id", "hit_ord", "brand", "reference")
        cited = unique.join(hints, ["mission_id", "hit_ord"])
        said = cut(leads.sightings(documents(cited, F.array(F.struct("brand", "reference")), False), missions, requirements))
        rows = rows.join(said.filter("reason IS NULL").select("mission_id").distinct(), "mission_id", "left_anti")
    own = leads.sightings(documents(rows), missions, requirements)
    return cut(own if said is None else said.unionByName(own))


def expected_on(pages: DataFrame, active: DataFrame, target: DataFrame) -> DataFrame:
    """pages with `expected`, the references of leads that a page shows and its own codes, and `brands`, the mission's target brand."""
    document = F.struct("url", "title", F.lit("").alias("snippet"), "content")
    held = pages.select("mission_id", document.alias("document"))
    proposed = held.join(active.select("mission_id", F.col("rank").alias("ord"), F.lit("mpn").alias("kind"), F.col("reference").alias("value")), "mission_id")
    own = held.select("mission_id", "document", F.posexplode(identity.fallback_identities(F.col("document.title"), F.col("document.content"))).alias("ord", "value")).select("mission_id", "document", (100 + F.col("ord")).alias("ord"), F.lit("mpn").alias("kind"), "value")
    known = identity.raw_identifiers(identity.extract_identities(proposed.unionByName(own)))
    brand = F.when(F.trim(F.coalesce("target_brand", F.lit(""))) != "", F.array("target_brand"))
    return pages.join(known, ["mission_id", "url"], "left").join(target.select("mission_id", brand.alias("brands")), "mission_id", "left")


def research(missions: DataFrame, requirements: DataFrame, providers: Providers, brands: Brands = Brands(), domains: tuple[str, ...] = ()) -> Outcome:
    """All waves of all missions; `missions` and `requirements` as in schemas. `domains`: shops, by configuration."""
    spark = missions.sparkSession
    state = State(missions, requirements)
    read = [empty(spark, "mission_id string, audit_ord int, page_url string, answer string")]
    pages_schema = "mission_id string, url string, title string, content string, page_ord int, mode string, expected array<string>, brands array<string>, reason string, accepted boolean, matched array<string>, content_length int"
    verdicts, done, asked_all = [empty(spark, pages_schema)], [empty(spark, "mission_id string, wave int, mode string, sent int, queries int, pages int")], [empty(spark, f"mission_id string, wave int, query_ord int, query string, kind string, keys {KEYS}")]
    diagnostics, refused = [payloads.audits_of(read[0])[1]], [empty(spark, "mission_id string, brand string, reference string, reason string, url string")]
    criteria, evaluations = payloads.audits_of(read[0])[0], None

    def ingest(seen: DataFrame) -> None:
        refused.append(seen.filter("reason IS NOT NULL").select("mission_id", "brand", "reference", "reason", "url"))
        state.registry = cut(leads.absorb(state.registry, seen))

    for wave in range(1, waves.MOST_WAVES + 1):
        limits = waves.budgets(state.open)
        budget = cut(limits.join(state.open.select("mission_id", "forced", "near"), "mission_id"))
        if budget.isEmpty():
            break
        asked = cut(planned(state, missions, requirements, budget, domains))
        asked_all.append(asked.select("mission_id", F.lit(wave).alias("wave"), "query_ord", "query", "kind", "keys"))
        mode = cut(asked.groupBy("mission_id").agg(F.min("mode").alias("mode")))
        wanted = F.when(F.size("keys") > 0, F.transform("keys", lambda x: x["reference_key"]))
        found = cut(providers.search(asked.select("mission_id", "query_ord", "query")).join(asked.select("mission_id", "query_ord", "keys", wanted.alias("references")), ["mission_id", "query_ord"]))
        in_mode = lambda rows, name: rows.join(mode.filter(F.col("mode") == name).select("mission_id"), "mission_id", "left_semi")  # noqa: B023, E731
        ingest(seen_in_hits(in_mode(found, "discovery"), missions, requirements, providers.hint))

        # pages: new ones, and old ones that show a lead that was asked for or audited since
        chosen = hits.select_pages(found.drop("keys"), state.pages.select("mission_id", canonical_url("url").alias("url")), waves.PAGES_PER_WAVE).join(budget.select("mission_id", F.col("pages").alias("_most")), "mission_id").filter(F.col("position") <= F.col("_most"))
        chosen = cut(chosen.select("mission_id", "url", "canonical", "position"))
        got = providers.fetch(chosen.select("mission_id", "url")).select("mission_id", "url", "title", "content").join(chosen, ["mission_id", "url"])
        active = cut(leads.active(state.registry))
        asked_for = asked.select("mission_id", F.explode("keys").alias("key")).select("mission_id", "key.*")
        again = cut(leads.cached_pages(active, state.audited.unionByName(asked_for).distinct(), state.pages, state.reread).join(mode.select("mission_id"), "mission_id", "left_semi"))
        shown = found.withColumn("canonical", canonical_url("url")).groupBy("mission_id", "canonical").agg(F.transform(F.array_sort(F.collect_set(F.when(F.coalesce("snippet", F.lit("")) != "", F.struct("query_ord", "rank", "snippet")))), lambda x: x["snippet"]).alias("snippets"), F.min("rank").alias("rank"), F.min_by("title", F.struct("query_ord", "rank")).alias("hit_title"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("keys", F.array().cast(KEYS))))).alias("keys"))
        new = got.join(shown, ["mission_id", "canonical"], "left").select("mission_id", "url", F.when(F.trim(F.coalesce("title", F.lit(""))) != "", F.col("title")).otherwise(F.coalesce("hit_title", F.lit(""))).alias("title"), F.coalesce("content", F.lit("")).alias("content"), (100 * wave + F.col("position")).cast("int").alias("page_ord"), F.coalesce("snippets", F.array().cast(STRINGS)).alias("snippets"), F.coalesce("rank", F.lit(1)).alias("rank"), F.coalesce("keys", F.array().cast(KEYS)).alias("keys"), F.lit(False).alias("cached"))
        nth = F.row_number().over(Window.partitionBy("mission_id").orderBy("url"))
        old = again.join(state.pages.select("mission_id", "url", "title", "content"), ["mission_id", "url"]).select("mission_id", "url", "title", "content", (100 * wave + 50 + nth).cast("int").alias("page_ord"), F.array().cast(STRINGS).alias("snippets"), F.lit(1).alias("rank"), "keys", F.lit(True).alias("cached"))
        batch = cut(new.unionByName(old).join(mode, "mission_id").withColumn("ord", F.col("page_ord")))
        ingest(cut(leads.sightings(documents(in_mode(batch, "discovery")), missions, requirements)))
        state.pages = cut(state.pages.unionByName(batch.filter("NOT cached").select("mission_id", "url", "title", "content", F.lit(wave).alias("wave"), "page_ord")))
        state.reread = cut(state.reread.unionByName(again.select("mission_id", "url", F.explode("keys").alias("key")).select("mission_id", "url", "key.*")))

        # the gate knows the leads of before this wave's pages; a page is read for the leads that it was opened for, or shows
        told = gate.qualify(expected_on(batch, active, missions).withColumn("mode", gate.mode_for(F.col("mode")))).join(mode.withColumnRenamed("mode", "analysis"), "mission_id")
        told = cut(told)
        verdicts.append(told.filter("NOT cached").select("mission_id", "url", "title", "content", "page_ord", "mode", "expected", "brands", "reason", "accepted", "matched", "content_length"))
        here = state.registry.select(*IDENTITY, F.explode("seen.url").alias("u")).select(*IDENTITY, canonical_url("u").alias("canonical")).distinct()
        placed = told.filter("accepted").withColumn("canonical", canonical_url("url"))
        sought = placed.select("mission_id", "url", F.explode("keys").alias("key")).select("mission_id", "url", "key.*").join(active.select(*IDENTITY), IDENTITY)
        sought = cut(sought.unionByName(placed.filter("analysis = 'discovery'").join(here, ["mission_id", "canonical"]).select("mission_id", "url", "brand_key", "reference_key")).distinct())
        declared = sought.join(leads.active(state.registry).select(*IDENTITY, "brand", "reference"), IDENTITY).groupBy("mission_id", "url").agg(F.array_sort(F.collect_set(F.struct("brand", "reference"))).alias("declared"))
        requests = cut(placed.join(declared, ["mission_id", "url"], "left").select("mission_id", F.col("page_ord").alias("audit_ord"), F.col("url").alias("page_url"), "title", "content", F.col("analysis").alias("mode"), "declared"))
        good = k.udf(lambda a: payloads.first_json(a) is not None, "boolean")(F.col("answer"))
        ask = lambda rows: providers.audit(rows).select("mission_id", "audit_ord", "page_url", "answer")
        answers, broken, twice = retries.repaired(ask, requests, good, "mission_id", "audit_ord")
        rows, wrong = payloads.audits_of(cut(answers))
        repeated = broken.select("mission_id", "audit_ord").distinct().join(twice.select("mission_id", "audit_ord").distinct(), ["mission_id", "audit_ord"], "left_anti")
        mended = repeated.select("mission_id", "audit_ord", F.lit("page_audit").alias("stage"), F.lit("$").alias("path"), F.lit("json_parse_error").alias("issue"), F.lit("retried").alias("action"))
        diagnostics.append(cut(wrong.unionByName(mended.select(*wrong.columns))))
        in_target = rows.join(mode.filter("mode = 'targeted'").select("mission_id"), "mission_id", "left_semi")
        free = in_mode(rows, "discovery")
        texts = batch.select("mission_id", "url", "title", "content")
        checked = cut(leads.page_candidates(free, texts).unionByName(leads.page_candidates(in_target, texts, sought.withColumnRenamed("url", "page_url"))))
        key = k.udf(k.identity_key, "string")
        state.audited = cut(state.audited.unionByName(checked.select("mission_id", key("brand").alias("brand_key"), key("reference").alias("reference_key"))).distinct())
        offers = checked.groupBy("mission_id", F.col("page_url").alias("url")).agg(F.transform(F.array_sort(F.collect_set(F.struct("candidate_id", "brand", "reference"))), lambda x: F.struct(x["brand"], x["reference"])).alias("offers"))
        proposed = documents(in_mode(placed, "discovery").withColumn("ord", F.col("page_ord")).join(offers, ["mission_id", "url"]), F.col("offers"), False)
        ingest(cut(leads.sightings(proposed.unionByName(documents(in_mode(placed, "targeted").withColumn("ord", F.col("page_ord")))), missions, requirements)))

        criteria = cut(criteria.unionByName(checked))
        if evaluations is None or not batch.isEmpty():  # else nothing is new
            valid, evaluations = judged(criteria, requirements, missions, state.pages.select("mission_id", "url", "title", "content", "page_ord"), brands)
        close(state, wave, budget, asked, mode, batch, valid, evaluations, requirements)
        done.append(state.closed)

    if evaluations is None:
        _, evaluations = judged(criteria, requirements, missions, state.pages, brands)
    registry = leads.active(state.registry)
    counted = gate.counters(payloads.union(verdicts))
    results = results_of(missions, evaluations, payloads.union(done), counted, registry)
    return Outcome(evaluations, results, state.pages, payloads.union(verdicts), payloads.union(diagnostics), payloads.union(done), payloads.union(asked_all), registry, payloads.union(refused).distinct())


def close(state: State, wave: int, budget: DataFrame, asked: DataFrame, mode: DataFrame, batch: DataFrame, valid: DataFrame, evaluations: DataFrame, requirements: DataFrame) -> None:
    """Books what a wave sent and proved, and plans near-miss queries for the next one."""
    key = k.udf(k.identity_key, "string")
    none = F.array().cast(STRINGS)
    state.sent = cut(state.sent.unionByName(asked.select("mission_id", "query")))
    sent = asked.filter("kind = 'lead'").select("mission_id", F.explode("keys").alias("key")).select("mission_id", "key.*").groupBy(*IDENTITY).agg(F.count("*").alias("n"))
    state.angles = cut(state.angles.unionByName(sent).groupBy(*IDENTITY).agg(F.sum("n").alias("n")))
    proven = cut(valid.filter("status = 'proven'").select("mission_id", key("brand").alias("brand_key"), key("reference").alias("reference_key"), F.col("requirement_id").alias("label")).distinct())
    on = waves.progressed(state.proven, proven)
    state.proven = proven
    spent = budget.select("mission_id", "near").join(mode, "mission_id", "left").join(asked.groupBy("mission_id").agg(F.count("*").cast("int").alias("sent")), "mission_id", "left").join(batch.filter("NOT cached").groupBy("mission_id").agg(F.count("*").cast("int").alias("p")), "mission_id", "left")
    now = state.open.drop("wave", "forced", "near").join(spent, "mission_id").join(on, "mission_id", "left").fillna(0, ["sent", "p"]).fillna(False, ["progressed"]).fillna("discovery", ["mode"])
    now = cut(now.withColumns({"wave": F.lit(wave), "queries": (F.col("queries") + F.col("sent")).cast("int"), "pages": (F.col("pages") + F.col("p")).cast("int"), "forced": (F.col("mode") == "targeted") & ~F.col("progressed")}))
    state.closed = now.select("mission_id", "wave", "mode", "sent", "queries", "pages")

    told = evaluations.filter("error IS NULL AND NOT eligible")
    urls = valid.groupBy("mission_id", "candidate_id").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("proofs.url").alias("u")))), lambda x: x["u"]))).alias("urls"))
    told = told.join(urls, ["mission_id", "candidate_id"], "left").withColumn("identity", F.col("reference")).withColumn("family", near_miss.search_family(F.col("reference"), F.coalesce("urls", none)))
    known = state.signatures.groupBy("mission_id").agg(F.collect_set("signature").alias("seen_signatures"))
    left = F.least(waves.MOST_QUERIES - F.col("queries"), NEAR_MISS_QUERIES - F.col("near"))
    room = now.select("mission_id", F.greatest(left, F.lit(0)).alias("budget")).join(known, "mission_id", "left").withColumn("seen_signatures", F.coalesce("seen_signatures", none))
    picked = cut(near_miss.select_queries(near_miss.targeted_tasks(near_miss.assess(told, requirements)), room))
    state.signatures = cut(state.signatures.unionByName(picked.select("mission_id", "signature")).distinct())
    deferred = state.pending.join(state.sent, ["mission_id", "query"], "left_anti")
    fresh = picked.select("mission_id", (100 * wave + F.col("position")).cast("int").alias("position"), "query").join(state.sent, ["mission_id", "query"], "left_anti")
    state.pending = cut(deferred.unionByName(fresh).groupBy("mission_id", "query").agg(F.min("position").alias("position")).select("mission_id", "position", "query"))
    near = picked.groupBy("mission_id").agg(F.count("*").cast("int").alias("more"))
    best = evidence.best_candidates(evaluations).select("mission_id", F.concat("not_proven_criteria", "incompatible_criteria").alias("missing"))
    every = requirements.groupBy("mission_id").agg(labels(F.struct("ord", "label")).alias("all"))
    state.missing = cut(every.join(best, "mission_id", "left").select("mission_id", F.coalesce("missing", "all").alias("missing")))
    # a discovery without a query left says nothing new in the next wave either
    idle = (F.col("sent") == 0) & (F.col("mode") == "discovery")
    state.open = cut(now.filter(~idle).join(near, "mission_id", "left").select("mission_id", "wave", "queries", "pages", "forced", (F.col("near") + F.coalesce("more", F.lit(0))).alias("near")))


def results_of(missions: DataFrame, evaluations: DataFrame, done: DataFrame, counted: DataFrame, registry: DataFrame) -> DataFrame:
    """mission_id, status, final_state, stop_reason: what a mission found, and why its loop ended."""
    spent = done.groupBy("mission_id").agg(F.max("queries").alias("queries"))
    judged_ = evaluations.filter("error IS NULL").groupBy("mission_id").agg(F.count("*").alias("judged"))
    led = registry.select("mission_id", F.lit(True).alias("led")).distinct()
    rows = evidence.mission_status(missions, evaluations)
    for part in (spent, judged_, counted, led):
        rows = rows.join(part, "mission_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    reason = F.when(F.col("status") == "complete", "PROVEN_EQUIVALENT").when(n("queries") >= waves.MOST_QUERIES, "QUERY_BUDGET_EXHAUSTED").when(n("pages_analyzed") >= waves.MOST_PAGES, "PAGE_BUDGET_EXHAUSTED").when((n("pages_rejected_by_gate") > 0) & (n("pages_analyzed") == 0), "PRODUCT_CONTENT_NOT_RETRIEVED").when(n("judged") > 0, "NO_PROVABLE_CANDIDATE").otherwise("MAX_WAVES_REACHED")
    final = F.when((F.col("final_state") == "no_candidate_discovered") & F.col("led"), "candidates_discovered_but_not_audited").otherwise(F.col("final_state"))
    return rows.select("mission_id", "status", final.alias("final_state"), reason.alias("stop_reason"))
