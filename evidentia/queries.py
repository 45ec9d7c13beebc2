"""Driver queries: the engine's operators over the test tables, each with its DuckDB equivalent where SQL has one.

The tables hold no audits, so benchmark items stand for excerpts, documents and pages for pages, and orders, events and
parts for requirements, statuses and waves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import urls
from evidentia.operators import evidence, gate, hits, identity, literal

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def literal_pairs(spark: SparkSession, d: str) -> DataFrame:
    """item_id, n_parts, doc_id, source, part of each sentence that stands literally in a document."""
    parts = t(spark, d, "benchmark").select("item_id", F.posexplode(F.filter(F.split("text", r"(?<=[.])\s+"), lambda s: s != "")).alias("part", "sentence"))
    parts = parts.withColumn("n_parts", F.count("*").over(Window.partitionBy("item_id")))
    found = literal.occurrences(parts.withColumnRenamed("sentence", "phrase"), t(spark, d, "documents").select("doc_id", "source", "text"))
    return found.select("item_id", "n_parts", "doc_id", "source", "part").distinct()


PARTS_SQL = r"""WITH s AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(regexp_replace(text, '\.\s+', '.' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS sentence, text FROM benchmark),
p AS (SELECT item_id, sentence, row_number() OVER (PARTITION BY item_id) AS part, count(*) OVER (PARTITION BY item_id) AS n_parts FROM s),
f AS (SELECT item_id, n_parts, doc_id, source, part FROM p JOIN documents d ON contains(d.text, p.sentence))"""


@query(PARTS_SQL + """, e AS (SELECT item_id, doc_id, any_value(source) AS source, CAST(100 * count(DISTINCT part) // any_value(n_parts) AS BIGINT) AS score FROM f GROUP BY item_id, doc_id),
c AS (SELECT *, count(DISTINCT source) OVER (PARTITION BY item_id) AS n_sources FROM e)
SELECT item_id, doc_id, score, n_sources, score >= 75 AS eligible FROM c QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, source, doc_id) = 1""")
def literal_proof_score(spark: SparkSession, d: str) -> DataFrame:
    """Score 100 * proven div notable of each (item, document), corroborating sources, top 1 of each item."""
    e = literal_pairs(spark, d).groupBy("item_id", "doc_id").agg(F.first("source").alias("source"), F.countDistinct("part").alias("n"), F.first("n_parts").alias("n_parts"))
    e = e.withColumn("score", F.expr("100 * n div n_parts"))
    n = e.groupBy("item_id").agg(F.countDistinct("source").alias("n_sources"))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "source", "doc_id")
    return e.withColumn("_n", F.row_number().over(best)).filter("_n = 1").join(n, "item_id").select("item_id", "doc_id", "score", "n_sources", (F.col("score") >= 75).alias("eligible"))


@query(PARTS_SQL + " SELECT DISTINCT item_id FROM benchmark ANTI JOIN f USING (item_id)")
def proof_missing(spark: SparkSession, d: str) -> DataFrame:
    """Items without any literal proof: not proven by default."""
    return t(spark, d, "benchmark").select("item_id").distinct().join(literal_pairs(spark, d).select("item_id").distinct(), "item_id", "left_anti")


CANONICAL_SQL = r"""(SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END
|| coalesce('?' || nullif(array_to_string(list_filter(string_split(nullif(regexp_extract(url, '\?([^#]*)', 1), ''), '&'), lambda x: NOT regexp_matches(x, '^(utm_.*|gclid|fbclid|srsltid)=')), '&'), ''), '') AS canonical FROM pages)"""


@query(f"SELECT canonical, count(*) AS n, min(page_id) AS first_page FROM {CANONICAL_SQL} GROUP BY canonical")
def url_canonical_groups(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "pages").select("page_id", urls.canonical_url("url").alias("canonical"))
    return p.groupBy("canonical").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query(r"SELECT page_id, regexp_matches(url, '[?&](page|sort-by|sort_by|tri|_nkw|q|search)=') OR regexp_matches(url, '/(shop|search|cat|collections|manufacturers|g)(/|$|\?|#)') AS is_list FROM pages")
def url_list_pages(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", urls.is_list_page(F.col("url")).alias("is_list"))


@query(r"SELECT page_id, regexp_matches(url, '//(careers|jobs|emploi|recrutement)\.') OR regexp_matches(url, '[/.](wikipedia\.org|facebook\.com|x\.com|reddit\.com|youtube\.com)/') OR regexp_matches(url, '(?i)/glossaire|/glossary|/lexique|/forums?/|/encyc|/blog/|/guides?/|/actualites?/|/news/|/wiki/|definition[-_]') AS off_topic FROM pages")
def url_offtopic(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", urls.is_off_topic(F.col("url")).alias("off_topic"))


@query(r"SELECT array_to_string(string_split(regexp_extract(url, '://([^/?#:]*)', 1), '.')[-2:], '.') AS domain, count(*) AS n FROM pages GROUP BY 1")
def source_domains(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").groupBy(urls.domain_of(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT *, page_id % 5 AS mission_id, page_id % 3 AS query_ord, page_id % 12 + 1 AS rank FROM {CANONICAL_SQL}),
k AS (SELECT * FROM c WHERE NOT regexp_matches(url, '[?&](page|sort-by|sort_by|tri|_nkw|q|search)=') AND NOT regexp_matches(url, '/blog/|/news/|/wiki/')),
g AS (SELECT mission_id, canonical, min((rank, query_ord)) AS o FROM k GROUP BY ALL)
SELECT CAST(mission_id AS VARCHAR) AS mission_id, canonical, CAST(row_number() OVER (PARTITION BY mission_id ORDER BY o, canonical) AS INTEGER) AS position FROM g QUALIFY position <= 12""")
def fair_page_selection(spark: SparkSession, d: str) -> DataFrame:
    """Twelve pages for each of five missions, by rank, then query, each canonical URL once."""
    p = t(spark, d, "pages").select((F.col("page_id") % 5).cast("string").alias("mission_id"), (F.col("page_id") % 3).alias("query_ord"), F.lit("any").alias("query"), (F.col("page_id") % 12 + 1).alias("rank"), "url", F.lit("").alias("title"), F.lit("").alias("snippet"), F.lit(None).cast("array<string>").alias("references"))
    return hits.select_pages(p, None, 12).select("mission_id", "canonical", "position")


@query("""SELECT page_id, CASE WHEN regexp_matches(url, '[?&](page|sort-by|sort_by|tri|_nkw|q|search)=') THEN 'REJECTED_FOR_PRODUCT_EVIDENCE' WHEN page_id % 7 = 0 THEN 'NOT_READY_FOR_PRODUCT_EVIDENCE'
WHEN contains(lower(html), 'footer') AND page_id % 2 = 0 OR contains(lower(html), 'zz-no-such-code') THEN 'ACCEPTED' ELSE 'REJECTED_FOR_PRODUCT_EVIDENCE' END AS reason, length(html) AS content_length FROM pages""")
def page_gate(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on pages: every seventh has no identifiers, even ones seek a word that stands there."""
    expected = F.when(F.col("page_id") % 7 == 0, F.array().cast("array<string>")).when(F.col("page_id") % 2 == 0, F.array(F.lit("FOOTER"))).otherwise(F.array(F.lit("zz-no-such-code")))
    p = t(spark, d, "pages").select("page_id", "url", F.col("html").alias("content"), F.lit("PRODUCT_EVIDENCE").alias("mode"), expected.alias("expected"), F.lit(None).cast("array<string>").alias("brands"))
    return gate.qualify(p).select("page_id", "reason", F.col("content_length").cast("bigint").alias("content_length"))


@query("SELECT CAST(page_id % 4 AS VARCHAR) AS mission_id, count(*) AS pages_fetched, count(*) FILTER (page_id % 3 = 0) AS pages_analyzed, count(*) FILTER (page_id % 3 = 1) AS pages_rejected_by_gate, count(*) FILTER (page_id % 3 = 2) AS pages_not_ready_for_evidence FROM pages GROUP BY 1")
def gate_counters(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("page_id") % 3
    return gate.counters(t(spark, d, "pages").select((F.col("page_id") % 4).cast("string").alias("mission_id"), (m == 0).alias("accepted"), F.when(m == 0, "ACCEPTED").when(m == 1, "REJECTED_FOR_PRODUCT_EVIDENCE").otherwise("NOT_READY_FOR_PRODUCT_EVIDENCE").alias("reason")))


@query()
def set_cover(spark: SparkSession, d: str) -> DataFrame:
    """The fewest days that show all of a user's kinds of events."""
    e = t(spark, d, "events").select(F.col("user_id").alias("key"), F.dense_rank().over(Window.partitionBy("user_id").orderBy(F.to_date("ts"))).alias("page_ord"), F.to_date("ts").cast("string").alias("url"), F.col("event_type").alias("criterion"))
    return evidence.minimum_pages(e)


@query()
def html_clean_lengths(spark: SparkSession, d: str) -> DataFrame:
    from evidentia.operators.pages import clean_html

    p = t(spark, d, "pages").withColumn("c", clean_html("html"))
    return p.select("page_id", F.length("c.title").alias("title_length"), F.length("c.content").alias("content_length"))


@query()
def spec_extraction(spark: SparkSession, d: str) -> DataFrame:
    from evidentia.operators.coverage import specifications

    return t(spark, d, "documents").select("doc_id", specifications("text").alias("specs")).filter(F.size("specs") > 0)


@query("SELECT 'demo' AS mission_id, 'complete' AS status, 'candidate_selected' AS final_state, 2 AS waves")
def replay_demo(spark: SparkSession, d: str) -> DataFrame:
    """The made-up corpus replayed; independent of the tables."""
    from evidentia.plans.replay import replay_tables
    from evidentia.sources import demo

    return replay_tables(spark, {"demo": demo.tables()}, demo.brands()).results


@query("""WITH d AS (SELECT p_partkey, lpad(CAST(p_partkey * 7919 + 400000000000 AS VARCHAR), 13, '0') AS ean FROM part),
s AS (SELECT p_partkey, ean, list_sum(list_transform(range(1, 14), lambda i: CAST(substr(ean, i, 1) AS INTEGER) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) AS w FROM d)
SELECT p_partkey, ean, w % 10 = 0 AS valid FROM s""")
def ean_checks(spark: SparkSession, d: str) -> DataFrame:
    from evidentia.functions import kernels as k

    p = t(spark, d, "part").select("p_partkey", F.lpad((F.col("p_partkey") * 7919 + 400000000000).cast("string"), 13, "0").alias("ean"))
    return p.withColumn("valid", k.udf(k.valid_ean, "boolean")("ean"))


@query()
def query_plans(spark: SparkSession, d: str) -> DataFrame:
    """Three deterministic queries for each part as a mission, from two requirements."""
    from evidentia.operators import planning

    none = F.array().cast("array<string>")
    m = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("mission_id"), F.col("p_name").alias("product"), F.lit("").alias("origin_brand"), F.lit("").alias("target_brand"), none.alias("missing"), none.alias("previous"), F.lit(None).cast("array<string>").alias("planned"))
    r = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("mission_id"), F.explode(F.array(F.struct(F.lit(0).alias("ord"), F.lit("size").alias("requirement_id"), F.lit("Size").alias("label"), F.format_string("%d mm", "p_size").alias("requested_value"), F.lit(True).alias("critical")), F.struct(F.lit(1).alias("ord"), F.lit("kind").alias("requirement_id"), F.lit("Type").alias("label"), F.col("p_type").alias("requested_value"), F.lit(False).alias("critical")))).alias("r")).select("mission_id", "r.*")
    return planning.plan(m, r)


@query()
def coverage_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Specifications of documents, as datasheets, that an empty list of requirements leaves uncovered."""
    from evidentia.operators import coverage

    sheets = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("mission_id"), F.lit("").alias("product"), F.col("text").alias("sheet"))
    r = sheets.select("mission_id", F.lit("Sealing").alias("label"), F.lit("none").alias("requested_value"))
    return coverage.orphans(sheets, r).select("mission_id", "value", "reason")


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+'), lambda x: regexp_full_match(x, '[0-9]{4,}')))), ',') AS anchors FROM documents")
def numeric_anchors(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(hits.numeric_anchors(F.coalesce("text", F.lit("")))), ",").alias("anchors"))


@query()
def identity_fallback(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", identity.fallback_identities(F.lit(""), F.col("text")).alias("codes"))


@query()
def page_identities(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", identity.page_identity_count(F.col("text")).alias("n"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity BETWEEN 10 AND 10 + l_linenumber * 5 END AS fits FROM lineitem""")
def quantity_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Requested points against observed ranges; every third observation is in another unit, so nothing can be told."""
    from evidentia.functions import quantity

    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.format_string("%d V", F.col("l_quantity").cast("int")).alias("requested"), F.when(F.col("l_linenumber") % 3 == 0, "10 - 20 A").otherwise(F.format_string("from 10 - %d V", 10 + F.col("l_linenumber") * 5)).alias("observed"))
    return quantity.compared(rows, "requested", "observed").select("l_orderkey", "l_linenumber", "fits")


def audited(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """criteria, requirements, missions, pages: each supplier is a mission with one candidate, audited on one shop's page.

    Every second candidate's voltage is off by one; every third claims a quotation that its page doesn't have."""
    s = t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("mission_id"), "s_suppkey", "s_nationkey")
    volt, seen, amp = (F.format_string(f, c.cast("int")) for f, c in (("%d V DC", F.col("s_nationkey") + 10), ("%d V DC", F.col("s_nationkey") + 10 + F.col("s_suppkey") % 2), ("%d A", F.col("s_nationkey") + 5)))
    s = s.withColumns({"volt": volt, "seen": seen, "amp": amp, "reference": F.format_string("AB-%d", F.col("s_suppkey").cast("int") + 100_000), "url": F.format_string("https://shop%d.example/p/%d", (F.col("s_suppkey") % 7).cast("int"), F.col("s_suppkey").cast("int"))})
    missions = s.select("mission_id", F.lit("Relay").alias("product"), F.lit("Zeta").alias("origin_brand"), F.lit("").alias("target_brand"), F.lit(60).alias("threshold"), F.lit(False).alias("strict"))
    row = lambda n, i, label, value, critical: F.struct(F.lit(n).alias("ord"), F.lit(i).alias("requirement_id"), F.lit(label).alias("label"), value.alias("requested_value"), F.lit(critical).alias("critical"))
    requirements = s.select("mission_id", F.explode(F.array(row(0, "volt", "Voltage", F.col("volt"), True), row(1, "curr", "Rated current", F.col("amp"), True), row(2, "prot", "Protection", F.lit("IP65"), False))).alias("r")).select("mission_id", "r.*")
    pages = s.select("mission_id", F.lit(0).alias("page_ord"), "url", F.lit("").alias("title"), F.concat(F.lit("Acme "), "reference", F.lit(" relay. Voltage "), "seen", F.lit(". Rated current "), "amp", F.lit(". Protection IP65.")).alias("content"))
    said = lambda n, i, value, observed, excerpt: F.struct(F.lit(n).alias("ord"), F.lit(i).alias("requirement_id"), value.alias("requested_value"), observed.alias("observed_value"), F.lit("proven").alias("status"), F.array(F.struct(F.col("url"), excerpt.alias("excerpt"), F.lit("web_secondaire").alias("type"))).alias("proofs"))
    quoted = F.when(F.col("s_suppkey") % 3 == 0, "Protection class IP65").otherwise("Protection IP65")
    each = F.array(said(0, "volt", F.col("volt"), F.col("seen"), F.concat(F.lit("Voltage "), "seen")), said(1, "curr", F.col("amp"), F.col("amp"), F.concat(F.lit("Rated current "), "amp")), said(2, "prot", F.lit("IP65"), F.lit("IP65"), quoted))
    criteria = s.select("mission_id", F.lit("0/0").alias("candidate_id"), F.lit("Acme").alias("brand"), "reference", F.col("url").alias("page_url"), F.lit(0).alias("audit_ord"), F.explode(each).alias("k")).select("mission_id", "candidate_id", "brand", "reference", "page_url", "audit_ord", "k.*")
    return criteria, requirements, missions, pages


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS mission_id, id AS requirement_id, CASE id WHEN 'volt' THEN CASE WHEN s_suppkey % 2 = 0 THEN 'proven' ELSE 'incompatible' END WHEN 'prot' THEN CASE WHEN s_suppkey % 3 = 0 THEN 'not_proven' ELSE 'proven' END ELSE 'proven' END AS status,
CAST(CASE WHEN id = 'prot' AND s_suppkey % 3 = 0 THEN 0 ELSE 1 END AS INTEGER) AS n_proofs, id = 'prot' AND s_suppkey % 3 = 0 AS evidence_rejected FROM supplier, (SELECT unnest(['volt', 'curr', 'prot']) AS id)""")
def proof_validation(spark: SparkSession, d: str) -> DataFrame:
    criteria, requirements, _, pages = audited(spark, d)
    return evidence.validate(criteria, requirements, pages).select("mission_id", "requirement_id", "status", F.size("proofs").alias("n_proofs"), "evidence_rejected")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS mission_id, CAST(100 * p // 3 AS INTEGER) AS score, s_suppkey % 2 = 0 AND 100 * p // 3 >= 60 AS eligible, false AS complete, true AS identity_confirmed,
CAST(s_suppkey % 2 AS INTEGER) AS n_incompatible, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_unverified FROM (SELECT s_suppkey, (1 - s_suppkey % 2) + 1 + CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END AS p FROM supplier)""")
def candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    criteria, requirements, missions, pages = audited(spark, d)
    scored = evidence.evaluate(evidence.validate(criteria, requirements, pages), requirements, missions, pages)
    return scored.select("mission_id", "score", "eligible", "complete", "identity_confirmed", F.size("incompatible_criteria").alias("n_incompatible"), F.size("unverified_criteria").alias("n_unverified"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS mission_id, CASE WHEN s_suppkey % 2 = 0 THEN 'partial' ELSE 'rejected' END AS status, CASE WHEN s_suppkey % 2 = 0 THEN 'candidate_selected' ELSE 'candidate_rejected' END AS final_state FROM supplier""")
def mission_outcomes(spark: SparkSession, d: str) -> DataFrame:
    criteria, requirements, missions, pages = audited(spark, d)
    scored = evidence.evaluate(evidence.validate(criteria, requirements, pages), requirements, missions, pages)
    return evidence.mission_status(missions, scored)


@query("""WITH c AS (SELECT s_suppkey, a, CASE a WHEN 0 THEN s_suppkey % 3 ELSE 2 * (s_suppkey % 2) END AS p FROM supplier, (SELECT unnest([0, 1]) AS a))
SELECT CAST(s_suppkey AS VARCHAR) AS mission_id, ['not_proven', 'incompatible', 'proven'][max(p) + 1] AS status, CAST(count(*) FILTER (p = m AND p > 0) AS INTEGER) AS n_proofs FROM (SELECT *, max(p) OVER (PARTITION BY s_suppkey) AS m FROM c) GROUP BY s_suppkey""")
def evidence_merge(spark: SparkSession, d: str) -> DataFrame:
    """One criterion audited on two pages: the best status, with the proofs of that status."""
    s = t(spark, d, "supplier").select("s_suppkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("audit_ord")).withColumn("p", F.when(F.col("audit_ord") == 0, F.col("s_suppkey") % 3).otherwise(2 * (F.col("s_suppkey") % 2)))
    url = F.format_string("https://shop.example/%d/%d", F.col("s_suppkey").cast("int"), "audit_ord")
    proofs = F.when(F.col("p") > 0, F.array(F.struct(url.alias("url"), F.lit("24 V DC").alias("excerpt"), F.lit("web_secondaire").alias("type")))).otherwise(F.array().cast(f"array<{evidence.PROOF}>"))
    rows = s.select(F.col("s_suppkey").cast("string").alias("mission_id"), F.concat(F.col("audit_ord").cast("string"), F.lit("/0")).alias("candidate_id"), F.lit("Acme").alias("brand"), F.when(F.col("audit_ord") == 0, "AB-1").otherwise("ab 1").alias("reference"), url.alias("page_url"), "audit_ord", F.lit(0).alias("ord"), F.lit("volt").alias("requirement_id"), F.lit("24 V DC").alias("requested_value"), F.lit("24 V DC").alias("observed_value"), F.element_at(F.array(*map(F.lit, ("not_proven", "incompatible", "proven"))), (F.col("p") + 1).cast("int")).alias("status"), proofs.alias("proofs"), F.lit(None).cast("string").alias("contract_error"), F.lit(False).alias("evidence_rejected"))
    return evidence.merge(rows).select("mission_id", "status", F.size("proofs").alias("n_proofs"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS mission_id, id AS requirement_id, CASE WHEN id = 'volt' AND s_suppkey % 2 = 1 THEN 'not_proven' ELSE 'proven' END AS status, CASE WHEN id = 'volt' AND s_suppkey % 2 = 1 THEN 'downgraded' WHEN id = 'prot' THEN 'proven' ELSE 'enriched' END AS reaudited, CAST(CASE WHEN id = 'prot' THEN 1 WHEN id = 'volt' AND s_suppkey % 2 = 1 THEN 0 ELSE 2 END AS INTEGER) AS n_proofs FROM supplier, (SELECT unnest(['volt', 'curr', 'prot']) AS id)""")
def second_pass(spark: SparkSession, d: str) -> DataFrame:
    """The maker's own page has everything as requested: it takes incompatibilities back, proves what is open, and confirms."""
    from evidentia.operators import reaudit
    from evidentia.operators.identity import Brands

    criteria, requirements, missions, pages = audited(spark, d)
    criteria = criteria.withColumn("status", F.when(F.col("requirement_id") == "prot", "not_proven").when((F.col("requirement_id") == "volt") & (F.col("observed_value") != F.col("requested_value")), "incompatible").otherwise(F.col("status")))
    wanted = requirements.groupBy("mission_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "label", "requested_value"))), lambda r: F.concat(r["label"], F.lit(" "), r["requested_value"])), ". ").alias("facts"))
    own = criteria.select("mission_id", "reference").distinct().join(wanted, "mission_id").select("mission_id", F.lit(1).alias("page_ord"), F.concat(F.lit("https://www.acme.example/"), F.lower("reference")).alias("url"), F.lit("").alias("title"), F.concat(F.lit("Acme "), "reference", F.lit(" relay. "), "facts", F.lit(".")).alias("content"))
    brands = Brands({frozenset(["acme"]): frozenset(["acme.example"])})
    return reaudit.reaudit(criteria, requirements, missions, pages.unionByName(own), brands).select("mission_id", "requirement_id", "status", "reaudited", F.size("proofs").alias("n_proofs"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS mission_id, c_custkey % 4 < 3 AS near_miss, CASE c_custkey % 4 WHEN 2 THEN 'NEAR_MISS_UNVERIFIED_CRITERION:volt' WHEN 3 THEN 'NOT_ELIGIBLE_TOO_MANY_BLOCKERS' ELSE 'NEAR_MISS_BLOCKING_CRITERION:volt' END AS reason,
CASE c_custkey % 4 WHEN 0 THEN 'ESTABLISHED' WHEN 1 THEN 'DIRECTIONAL' WHEN 2 THEN 'INCOMPLETE' END AS path, CAST([2, 1, 2, 0][c_custkey % 4 + 1] AS INTEGER) AS n_proven, CAST([1, 1, 0, 3][c_custkey % 4 + 1] AS INTEGER) AS n_blockers FROM customer""")
def near_miss_paths(spark: SparkSession, d: str) -> DataFrame:
    from evidentia.operators import near_miss

    return near_miss.assess(*rejected(spark, d)).select("mission_id", "near_miss", "reason", "path", "n_proven", "n_blockers")


def rejected(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Evaluations and requirements: each customer a mission with a candidate that is rejected in one of four ways."""
    c = t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("mission_id"), (F.col("c_custkey") % 4).alias("w"), "c_custkey")
    pick = lambda *ways: F.element_at(F.array(*[F.array(*map(F.lit, x)).cast("array<string>") for x in ways]), (F.col("w") + 1).cast("int"))
    rows = c.select("mission_id", F.lit("0/0").alias("candidate_id"), F.lit(False).alias("eligible"), F.format_string("AB-%d", F.col("c_custkey").cast("int")).alias("identity"), F.lit("").alias("family"), pick(("Poles", "Protection"), ("Poles",), ("Poles", "Protection"), ()).alias("proven_criteria"), pick(("Coil voltage",), ("Coil voltage",), (), ("Coil voltage", "Poles", "Protection")).alias("incompatible_criteria"), pick((), (), ("Coil voltage",), ()).alias("not_proven_criteria"), pick((), (), (), ()).alias("unverified_criteria"))
    req = F.array(*[F.struct(F.lit(n).alias("ord"), F.lit(i).alias("requirement_id"), F.lit(label).alias("label"), F.lit(v).alias("requested_value")) for n, (i, label, v) in enumerate((("volt", "Coil voltage", "24 V DC"), ("pole", "Poles", "3"), ("prot", "Protection", "IP20")))])
    return rows, c.select("mission_id", F.explode(req).alias("r")).select("mission_id", "r.*")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS mission_id, 'ab ' || c_custkey || '|volt|24 v dc' AS signature, 'volt' AS criterion, '24 V DC' AS target_value, 0 AS priority FROM customer WHERE c_custkey % 4 < 3""")
def near_miss_tasks(spark: SparkSession, d: str) -> DataFrame:
    from evidentia.operators import near_miss

    return near_miss.targeted_tasks(near_miss.assess(*rejected(spark, d))).select("mission_id", "signature", "criterion", "target_value", "priority")


@query("SELECT CAST(user_id AS VARCHAR) AS mission_id, event_type AS page_url, CAST(min(event_id % 4) AS INTEGER) AS wave FROM events GROUP BY ALL")
def journal_distinct(spark: SparkSession, d: str) -> DataFrame:
    """The first wave of entries that say the same."""
    from evidentia.plans import replay

    none, zero, no = F.array().cast("array<string>"), F.lit(0), F.lit(False)
    lists = {c: none for c in ("proven_criteria", "not_proven_criteria", "incompatible_criteria", "critical_blockers", "unverified_criteria", "downgraded")}
    e = t(spark, d, "events").select(F.col("user_id").cast("string").alias("mission_id"), F.col("event_type").alias("page_url"), (F.col("event_id") % 4).cast("int").alias("wave"), F.lit("Acme").alias("brand"), F.lit("AB-1").alias("reference"), zero.alias("score"), no.alias("eligible"), no.alias("complete"), zero.alias("official_proof_count"), zero.alias("proof_url_count"), F.lit(None).cast("string").alias("error"))
    return replay.journal(e.withColumns(lists)).select("mission_id", "page_url", "wave")


@query("""SELECT e.user_id || '#' || w.wave AS mission_id, count(*) AS n, max(event_id) AS last_event FROM (SELECT unnest([1, 2, 3, 4]) AS wave) w JOIN events e ON event_id % 4 + 1 <= w.wave GROUP BY 1""")
def wave_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Everything up to each of four waves, counted anew."""
    from evidentia.plans import replay

    e = t(spark, d, "events").select(F.col("user_id").cast("string").alias("mission_id"), "event_id", (F.col("event_id") % 4 + 1).cast("int").alias("wave"))
    waves = e.select("mission_id").distinct().withColumn("wave", F.explode(F.sequence(F.lit(1), F.lit(4))))
    return replay.by_wave(e, waves).groupBy("mission_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))


@query(r"""SELECT c_custkey, '!' || ['aa', 'bb', 'cc'][c_custkey % 3 + 1] || ' ' || trim(regexp_replace(c_mktsegment || '  relay', '\s+', ' ', 'g')) AS query, array_to_string(['aa', 'bb', 'cc'][c_custkey % 3 + 1:] || ['aa', 'bb', 'cc'][:c_custkey % 3], ',') AS engines FROM customer""")
def engine_rotation(spark: SparkSession, d: str) -> DataFrame:
    order = hits.engine_sequence(["aa", "bb", "cc"], F.col("c_custkey"))
    return t(spark, d, "customer").select("c_custkey", hits.bang_query(F.element_at(order, 1), F.concat(F.lit("!zz "), "c_mktsegment", F.lit("  relay"))).alias("query"), F.array_join(order, ",").alias("engines"))


@query("""SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'invalid_status' WHEN page_id % 6 = 4 THEN 'unusable_status' WHEN page_id % 5 = 0 THEN 'pdf' WHEN length(html) < 2000 THEN 'empty_content' ELSE 'success' END AS outcome, page_id % 6 = 4 AS blocked FROM pages""")
def response_classes(spark: SparkSession, d: str) -> DataFrame:
    from evidentia.sources import tables

    status = F.when(F.col("page_id") % 6 == 0, None).when(F.col("page_id") % 6 == 4, 403).otherwise(200)
    kind = F.when(F.col("page_id") % 5 == 0, "Application/PDF; x=1").otherwise("text/html")
    return t(spark, d, "pages").select("page_id", tables.classify_response(status, kind, F.lit("https://a.example/x"), F.length("html") - 1900).alias("outcome"), tables.is_blocked(status).alias("blocked"))


@query(f"""WITH c AS {CANONICAL_SQL}, k AS (SELECT DISTINCT canonical FROM c WHERE page_id % 2 = 0) SELECT page_id, sha256(canonical) AS key, canonical IN (SELECT canonical FROM k) AS hit FROM c""")
def page_cache(spark: SparkSession, d: str) -> DataFrame:
    """Pages of even numbers are in the cache; which requests does it answer?"""
    from evidentia.sources import tables

    now = F.to_timestamp(F.lit("2026-01-02 00:00:00"))
    p = t(spark, d, "pages").select("page_id", "url", F.lit("t").alias("title"), F.lit("text").alias("content"), F.lit("http").alias("mode"), F.lit(None).cast("array<string>").alias("warnings"))
    hit, miss = tables.cached(p.select("page_id", "url"), tables.to_cache(p.filter("page_id % 2 = 0"), now), now, "1 DAY")
    both = hit.select("page_id", "url", F.lit(True).alias("hit")).unionByName(miss.select("page_id", "url", F.lit(False).alias("hit")))
    return both.select("page_id", tables.cache_key(F.col("url")).alias("key"), "hit")


@query("""SELECT p_partkey, 'Brand: ' || p_brand || chr(10) || 'Reference: P-' || p_partkey || chr(10) || 'Product: ' || p_name || chr(10) || 'Size: ' || p_size AS datasheet, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_brand END AS sought FROM part""")
def datasheets(spark: SparkSession, d: str) -> DataFrame:
    from evidentia.sources import tables

    p = t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.format_string("P-%d", F.col("p_partkey").cast("int")).alias("reference"), F.col("p_name").alias("name"), F.create_map(F.lit("Size"), F.col("p_size").cast("string"), F.lit("None"), F.lit(" ")).alias("characteristics"), F.lit(None).cast("string").alias("text"))
    return tables.datasheet_text(p).select("p_partkey", "datasheet", tables.sought_brand(F.col("p_partkey") % 2 == 0, F.array(F.lit(" "), F.col("brand"))).alias("sought"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS mission_id, 'size' AS requirement_id, p_size || ' mm' AS requested_value, false AS critical FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'kind', p_type, true FROM part WHERE p_partkey % 5 <> 0""")
def answered_requirements(spark: SparkSession, d: str) -> DataFrame:
    from evidentia.operators import payloads

    return payloads.requirements_of(answers(spark, d))[0].select("mission_id", "requirement_id", "requested_value", "critical")


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Models' answers about parts: words around JSON, a blank item and a repeated id; every fifth is no JSON."""
    item = lambda i, label, value, critical: F.struct(F.lit(i).alias("id"), F.lit(label).alias("label"), value.alias("requested_value"), F.lit(critical).alias("critical"))
    made = F.to_json(F.struct(F.array(item("size", "Size", F.format_string("%d mm", "p_size"), False), item("", "Blank", F.lit("x"), True), item("kind", "Type", F.col("p_type"), True), item("kind", "Again", F.col("p_name"), True)).alias("criteria")))
    return t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("mission_id"), F.when(F.col("p_partkey") % 5 == 0, "I can't tell.").otherwise(F.concat(F.lit("Here it is: "), made, F.lit(" as you asked."))).alias("answer"))


@query("""SELECT path, issue, action, count(*) AS n FROM (SELECT unnest(CASE WHEN p_partkey % 5 = 0 THEN [('$', 'json_parse_error', 'aborted')] ELSE [('criteria[1].id', 'invalid_item', 'discarded'), ('criteria[3].id', 'invalid_item', 'discarded')] END) AS x, x[1] AS path, x[2] AS issue, x[3] AS action FROM part) GROUP BY ALL""")
def answer_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    from evidentia.operators import payloads

    return payloads.requirements_of(answers(spark, d))[1].groupBy("path", "issue", "action").agg(F.count("*").alias("n"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS mission_id, s_name AS brand, 'web_officiel' AS type, CAST(2 AS INTEGER) AS n_proofs FROM supplier""")
def answered_audits(spark: SparkSession, d: str) -> DataFrame:
    from evidentia.operators import payloads

    answer = F.concat(F.lit('{"candidates": [{"brand": "'), "s_name", F.lit('", "reference": "R-1", "criteria": [{"requirement_id": "a", "requested_value": "1", "status": "proven", "proofs": [{"url": "u", "excerpt": "e", "type": "Official"}, "quoted"]}, {"requirement_id": "b"}]}, 5]}'))
    rows = t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("mission_id"), F.lit(0).alias("audit_ord"), F.lit("https://a.example/").alias("page_url"), answer.alias("answer"))
    return payloads.audits_of(rows)[0].select("mission_id", "brand", F.col("proofs")[0]["type"].alias("type"), F.size("proofs").alias("n_proofs"))


@query("""SELECT event_id, event_id % 7 = 0 AS limited, event_id % 7 IN (0, 1, 2) AS temporary, CASE WHEN event_id % 6 > 3 THEN NULL WHEN event_id % 6 = 0 THEN 2.0 ELSE [1.0, 3.0, 8.0, 20.0][event_id % 6 + 1] END AS delay FROM events""")
def provider_errors(spark: SparkSession, d: str) -> DataFrame:
    from evidentia.operators import payloads

    n = F.col("event_id")
    status = F.when(n % 7 == 0, 429).when(n % 7 == 1, 503).when(n % 7 == 3, 404)
    return t(spark, d, "events").select("event_id", payloads.is_limited(status, F.lit("X")).alias("limited"), payloads.is_temporary(status, F.when(n % 7 == 2, "APITimeoutError")).alias("temporary"), payloads.retry_delay((n % 6).cast("int"), F.when(n % 6 == 0, 2.0).when(n % 6 == 1, 90.0)).alias("delay"))


@query("""WITH l AS (SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rank, n_nationkey % 3 AS sent FROM nation)
SELECT CAST(n_regionkey AS VARCHAR) AS mission_id, 'ab1234' || n_nationkey AS reference_key, CAST(sent AS BIGINT) AS angles, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY sent, rank) AS INTEGER) AS turn FROM l WHERE sent < 2""")
def targeted_leads(spark: SparkSession, d: str) -> DataFrame:
    from evidentia.operators import waves

    n = t(spark, d, "nation")
    leads = n.select(F.col("n_regionkey").cast("string").alias("mission_id"), F.lit("acme").alias("brand_key"), F.format_string("ab1234%d", F.col("n_nationkey").cast("int")).alias("reference_key"), F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).alias("rank"), (F.col("n_nationkey") % 3).alias("n"))
    return waves.targeted(leads.drop("n"), leads.filter("n > 0").select("mission_id", "brand_key", "reference_key", "n")).select("mission_id", "reference_key", "angles", "turn")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS mission_id, CAST(c_custkey % 5 + 1 AS INTEGER) AS wave, CAST(least(3, 12 - c_custkey % 14) AS INTEGER) AS queries, CAST(least(12, 36 - c_custkey % 40) AS INTEGER) AS pages FROM customer WHERE c_custkey % 5 < 4 AND c_custkey % 14 < 12 AND c_custkey % 40 < 36""")
def wave_budgets(spark: SparkSession, d: str) -> DataFrame:
    from evidentia.operators import waves

    part = lambda m: (F.col("c_custkey") % m).cast("int")
    return waves.budgets(t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("mission_id"), part(5).alias("wave"), part(14).alias("queries"), part(40).alias("pages")))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS mission_id, CASE WHEN c_custkey % 2 = 0 THEN NULL WHEN c_custkey % 3 > 0 THEN 'NO_PROVABLE_CANDIDATE' WHEN c_custkey % 5 > 0 THEN 'PRODUCT_CONTENT_NOT_RETRIEVED' WHEN c_custkey % 7 > 0 THEN 'NO_VALIDATED_IDENTITY' ELSE 'NO_PAGE_RETRIEVED' END AS reason FROM customer""")
def unresolved_reasons(spark: SparkSession, d: str) -> DataFrame:
    from evidentia.plans import diagnostics

    part = lambda m: (F.col("c_custkey") % m).cast("int")
    rows = t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("mission_id"), F.when(part(2) == 0, "complete").otherwise("not_resolved").alias("status"), part(3).alias("pages_analyzed"), part(5).alias("pages_rejected_by_gate"), part(7).alias("pages_not_ready_for_evidence"), (part(3) + part(5) + part(7)).alias("pages_fetched"))
    return diagnostics.unresolved_reason(rows).select("mission_id", "reason")


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS mission_id, string_agg(n_nationkey || ':' || CASE WHEN n_nationkey % 2 = 0 THEN 'targeted' ELSE '' END || ':' || greatest(n_nationkey - 5, 0), ',' ORDER BY n_nationkey) AS waves FROM nation GROUP BY n_regionkey""")
def wave_sections(spark: SparkSession, d: str) -> DataFrame:
    from evidentia.plans import diagnostics

    n = F.col("n_nationkey").cast("int")
    rows = t(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("mission_id"), n.alias("wave_index"), F.when(n % 2 == 0, "targeted").otherwise("raw text").alias("mode"), (n - 5).alias("query_count"), n.alias("logical_queries_before"), n.alias("logical_queries_after"), F.lit(None).cast("array<string>").alias("task_types"))
    shown = F.transform("waves", lambda w: F.concat_ws(":", w["wave_index"].cast("string"), w["mode"], w["query_count"].cast("string")))
    return diagnostics.waves_section(rows).select("mission_id", F.array_join(shown, ",").alias("waves"))


@query("""SELECT p_partkey, 'mpn' AS kind, 'P-' || p_partkey AS value, array_to_string(CASE WHEN p_partkey % 2 = 0 THEN ['title', 'content'] ELSE ['content'] END, ',') AS sources FROM part UNION ALL
SELECT p_partkey, 'ean', lpad(CAST(p_partkey * 7919 + 400000000000 AS VARCHAR), 13, '0'), 'content' FROM part WHERE list_sum(list_transform(range(1, 14), lambda i: CAST(substr(lpad(CAST(p_partkey * 7919 + 400000000000 AS VARCHAR), 13, '0'), i, 1) AS INTEGER) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10 = 0""")
def extracted_identities(spark: SparkSession, d: str) -> DataFrame:
    """Part numbers and EANs that stand on a part's page; wrong check digits and other kinds fall out."""
    n = F.col("p_partkey").cast("int")
    mpn, ean = F.format_string("P-%d", n), F.lpad((F.col("p_partkey") * 7919 + 400000000000).cast("string"), 13, "0")
    page = F.struct(F.format_string("https://a.example/%d", n).alias("url"), F.when(n % 2 == 0, F.concat(F.lit("Part "), mpn)).otherwise("Part").alias("title"), F.lit("").alias("snippet"), F.concat(F.lit("Number "), mpn, F.lit(", EAN "), ean).alias("content"))
    said = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in ((" MPN", mpn), ("ean", ean), ("color", F.lit("red")), ("mpn", F.concat(F.lit(" "), mpn)), ("model", F.lit("absent")))])
    rows = t(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("mission_id"), page.alias("document"), F.posexplode(said).alias("ord", "s")).select("p_partkey", "mission_id", "document", "ord", "s.*")
    return identity.extract_identities(rows).select(F.col("mission_id").cast("bigint").alias("p_partkey"), "kind", "value", F.array_join("sources", ",").alias("sources"))


@query("""SELECT p_partkey, p_partkey % 2 = 0 AS review FROM part""")
def unit_reviews(spark: SparkSession, d: str) -> DataFrame:
    from evidentia.operators import coverage

    rows = t(spark, d, "part").select("p_partkey", F.lit("Supply voltage").alias("label"), F.when(F.col("p_partkey") % 2 == 0, F.format_string("%d mm", "p_size")).otherwise(F.format_string("%d V", "p_size")).alias("requested_value"))
    return coverage.unit_disagreements(rows).select("p_partkey", "review")


@query("""WITH e AS (SELECT user_id, ts, event_id % 5 = 0 AS ok, CASE event_id % 7 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 404 END AS status, CASE WHEN event_id % 3 = 0 THEN 'APITimeoutError' END AS kind, CASE WHEN event_id % 11 = 0 THEN 12.0 WHEN event_id % 13 = 0 THEN 90.0 END AS asked, event_id FROM events),
a AS (SELECT *, coalesce(status = 429 OR status BETWEEN 500 AND 599, false) OR kind IS NOT NULL AS temporary, row_number() OVER o - 1 AS attempt FROM e WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, coalesce(bool_or(ok OR NOT temporary) OVER (PARTITION BY user_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM a),
c AS (SELECT *, CASE WHEN NOT ok AND temporary AND attempt < 4 THEN greatest([1.0, 3.0, 8.0, 20.0][attempt + 1], CASE WHEN asked <= 60 THEN asked ELSE 0.0 END) END AS delay FROM b WHERE NOT ended AND attempt <= 4)
SELECT user_id, CASE WHEN arg_max(ok, attempt) THEN 'succeeded' WHEN NOT arg_max(temporary, attempt) THEN 'failed' WHEN max(attempt) = 4 THEN 'exhausted' ELSE 'retry' END AS state, CAST(count(*) AS INTEGER) AS attempts, CAST(coalesce(sum(delay) FILTER (attempt < m), 0.0) AS DOUBLE) AS waited, CAST(max(delay) FILTER (attempt = m) AS DOUBLE) AS delay
FROM (SELECT *, max(attempt) OVER (PARTITION BY user_id) AS m FROM c) GROUP BY user_id""")
def provider_retries(spark: SparkSession, d: str) -> DataFrame:
    """Events as attempts of a request of each user: how it ended, or when it goes out again."""
    from evidentia.operators import retries

    n = F.col("event_id")
    e = t(spark, d, "events").select("user_id", F.col("ts").alias("at"), (n % 5 == 0).alias("ok"), F.when(n % 7 == 0, 429).when(n % 7 == 1, 503).when(n % 7 == 2, 404).alias("status"), F.when(n % 3 == 0, "APITimeoutError").alias("kind"), F.when(n % 11 == 0, 12.0).when(n % 13 == 0, 90.0).alias("asked"))
    return retries.outcomes(e, "user_id").select("user_id", "state", "attempts", "waited", "delay")


KEYS_SQL = """(SELECT DISTINCT regexp_extract(url, '://([^/?#:]*)', 1) AS host, regexp_replace(lower(url), '[^a-z0-9]', '', 'g') AS long, regexp_replace(lower(split_part(url, '?', 1)), '[^a-z0-9]', '', 'g') AS short FROM pages)"""


@query(f"""SELECT a.host AS brand_key, a.long AS reference_key, count(*) AS nested, max(length(b.short)) AS longest FROM (SELECT DISTINCT host, long FROM {KEYS_SQL}) a
JOIN (SELECT DISTINCT host, short FROM {KEYS_SQL}) b ON a.host = b.host AND (a.long = b.short OR (length(b.short) >= 8 AND contains(a.long, b.short)) OR (length(a.long) >= 8 AND contains(b.short, a.long))) GROUP BY ALL""")
def nested_identities(spark: SparkSession, d: str) -> DataFrame:
    """Letters and digits of each URL with those of its host's URLs up to a question mark that are equal or nested."""
    from evidentia.operators.matching import nested_pairs

    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    p = t(spark, d, "pages").select(F.lit("m").alias("mission_id"), F.regexp_extract("url", "://([^/?#:]*)", 1).alias("brand_key"), key(F.col("url")).alias("long"), key(F.split_part("url", F.lit("?"), F.lit(1))).alias("short"))
    a = p.select("mission_id", "brand_key", F.col("long").alias("reference_key")).distinct()
    b = p.select("mission_id", "brand_key", F.col("short").alias("reference_key")).distinct()
    return nested_pairs(a, b).groupBy("brand_key", "reference_key").agg(F.count("*").alias("nested"), F.max(F.length("other_key")).alias("longest"))


@query(r"""WITH b AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark), n AS (SELECT item_id, lower(w[1]) || ' ' || lower(w[2]) AS name FROM b WHERE len(w) >= 2),
d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' ' AS t FROM documents WHERE text IS NOT NULL)
SELECT item_id, count(*) AS documents FROM n JOIN d ON contains(t, ' ' || name || ' ') GROUP BY item_id""")
def stated_names(spark: SparkSession, d: str) -> DataFrame:
    """The first two words of each benchmark item as a name: the documents that state it."""
    from evidentia.functions import kernels as k
    from evidentia.operators.matching import meetings

    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    names = t(spark, d, "benchmark").filter(F.size(words) >= 2).select(F.lit("m").alias("mission_id"), "item_id", F.array(F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1)))).alias("names"))
    pages = t(spark, d, "documents").filter("text IS NOT NULL").select(F.lit("m").alias("mission_id"), F.col("doc_id").cast("string").alias("url"), F.col("text").alias("content"))
    near = meetings(names, pages, "item_id", "names").groupBy("mission_id", "url").agg(F.collect_list(F.struct("item_id", "names")).alias("near"))
    # a document is read once for all names that it may state, each as separate words
    stated = k.udf(lambda near, text: [n["item_id"] for text in [f" {' '.join(k.identity_words(text))} "] for n in near if f" {' '.join(k.identity_words(n['names'][0]))} " in text], "array<bigint>")
    return near.join(pages, ["mission_id", "url"]).select(F.explode(stated("near", "content")).alias("item_id")).groupBy("item_id").agg(F.count("*").alias("documents"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS mission_id, CAST(i AS INTEGER) AS candidate, r AS requirement_id, CASE WHEN p_partkey % 4 <> 3 AND p_partkey % 3 >= i AND r = 'size' THEN CASE WHEN (p_size + i) % 2 = 0 THEN 'proven' ELSE 'incompatible' END ELSE 'not_proven' END AS status, CASE WHEN p_partkey % 4 <> 3 AND p_partkey % 3 >= i AND r = 'size' THEN CAST(p_size + i AS VARCHAR) || ' mm' ELSE '' END AS observed_value
FROM part, (SELECT unnest([0, 1]) AS i), (SELECT unnest(['size', 'kind']) AS r)""")
def declared_grid(spark: SparkSession, d: str) -> DataFrame:
    """Two leads a part, read for its size and type: answers tell the size of the first ones, repeat it, and add what nobody asked for."""
    from evidentia.operators.declared import declared_audits

    p = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("mission_id"), "p_partkey", "p_size", "p_type")
    two = F.explode(F.array(F.lit(0), F.lit(1)))
    declared = p.select("mission_id", F.lit(0).alias("audit_ord"), two.alias("candidate_index"), F.lit("Acme").alias("brand"), F.lit("A-1").alias("reference"))
    requirements = p.select("mission_id", F.explode(F.array(F.struct(F.lit(0).alias("ord"), F.lit("size").alias("requirement_id"), F.format_string("%d mm", "p_size").alias("requested_value")), F.struct(F.lit(1).alias("ord"), F.lit("kind").alias("requirement_id"), F.col("p_type").alias("requested_value")))).alias("r")).select("mission_id", "r.*")
    item = lambda i: F.struct(F.lit("size").alias("requirement_id"), F.format_string("%d mm", F.col("p_size") + i).alias("observed_value"), F.when((F.col("p_size") + i) % 2 == 0, "proven").otherwise("incompatible").alias("status"))
    odd = F.struct(F.lit("colour").alias("requirement_id"), F.lit("red").alias("observed_value"), F.lit("proven").alias("status"))
    group = lambda i: F.struct(F.lit(i).alias("candidate_index"), F.array(item(i), odd, item(i + 1)).alias("criteria"))
    groups = F.slice(F.array(group(0), group(1)), 1, F.least(F.col("p_partkey") % 3 + 1, F.lit(2)).cast("int"))
    answer = F.when(F.col("p_partkey") % 4 == 3, '{"candidate_criteria": []}').otherwise(F.concat(F.lit("Read: "), F.to_json(F.struct(groups.alias("candidate_criteria")))))
    criteria, _ = declared_audits(p.select("mission_id", F.lit(0).alias("audit_ord"), F.lit("https://p.example").alias("page_url"), answer.alias("answer")), declared, requirements)
    return criteria.select("mission_id", F.split_part("candidate_id", F.lit("/"), F.lit(2)).cast("int").alias("candidate"), "requirement_id", "status", "observed_value")
