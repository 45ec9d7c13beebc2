"""Replay corpora: four JSON files a mission, read with explicit schemas into tables, and checked against each other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia import schemas
from evidentia.functions.urls import canonical_url


@dataclass(frozen=True)
class Corpus:
    missions: DataFrame
    requirements: DataFrame
    criteria: DataFrame  # with wave
    remarks: DataFrame
    pages: DataFrame  # with wave
    waves: DataFrame
    problems: DataFrame  # mission_id, problem: empty for a sound corpus


FILES = ("requirements", "audits", "pages", "manifest")


def load(spark: SparkSession, folders: list[str]) -> Corpus:
    """Corpora of folders; a folder is a mission, named by its last part. A mission with broken JSON is a problem of its own."""

    def texts(name: str) -> DataFrame:
        rows = spark.read.text([f"{f.rstrip('/')}/{name}.json" for f in folders], wholetext=True)
        return rows.select(F.regexp_extract(F.url_decode(F.input_file_name()), r"([^/]+)/[^/]+$", 1).alias("mission_id"), "value")

    return parse({name: texts(name) for name in FILES})


def load_tables(spark: SparkSession, corpora: dict[str, dict[str, str]]) -> Corpus:
    """Corpora given as JSON texts by mission and file name."""
    return parse({name: spark.createDataFrame([(m, files[name]) for m, files in corpora.items()], "mission_id string, value string") for name in FILES})


def parse(texts: dict[str, DataFrame]) -> Corpus:
    """`texts`: by file name a table of mission_id and value."""

    def rows(name: str, schema: str) -> DataFrame:
        whole = texts[name].filter(F.try_parse_json("value").isNotNull())
        return whole.select("mission_id", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("v"))

    broken = None
    for name in FILES:
        lost = texts[name].filter(F.try_parse_json("value").isNull()).select("mission_id", F.lit(f"{name}: broken JSON").alias("problem"))
        broken = lost if broken is None else broken.unionByName(lost)

    req = rows("requirements", f"struct<{typed(schemas.REQUIREMENTS_JSON)}>").select("mission_id", "v.*")
    man = rows("manifest", f"struct<{typed(schemas.MANIFEST_JSON)}>").select("mission_id", "v.*")
    audits = rows("audits", f"array<struct<page_url:string,candidates:array<{schemas.CANDIDATE}>>>").withColumnRenamed("v", "audits")
    pages = rows("pages", "map<string,string>").select("mission_id", F.posexplode("v").alias("page_ord", "url", "content"))

    missions = req.select("mission_id", "product", F.coalesce("origin_brand", F.lit("")).alias("origin_brand")).join(man.select("mission_id", "target_brand", "threshold", F.col("strict_evidence").alias("strict")), "mission_id")
    requirements = req.select("mission_id", F.posexplode("criteria").alias("ord", "c")).select("mission_id", "ord", F.col("c.id").alias("requirement_id"), "c.label", "c.requested_value", F.coalesce("c.critical", F.lit(True)).alias("critical"))
    one = audits.select("mission_id", F.posexplode("audits").alias("audit_ord", "a")).join(man.select("mission_id", "audit_waves"), "mission_id")
    one = one.select("mission_id", "audit_ord", F.col("a.page_url").alias("page_url"), F.get("audit_waves", F.col("audit_ord")).alias("wave"), F.col("a.candidates").alias("candidates"))
    people = one.select("mission_id", "audit_ord", "page_url", "wave", F.posexplode("candidates").alias("c_ord", "c")).withColumn("candidate_id", F.concat_ws("/", "audit_ord", "c_ord"))
    criteria = people.select("mission_id", "candidate_id", "c.brand", "c.reference", "page_url", "audit_ord", "wave", F.posexplode("c.criteria").alias("ord", "k"))
    criteria = criteria.select("mission_id", "candidate_id", "brand", "reference", "page_url", "audit_ord", "wave", "ord", "k.requirement_id", "k.requested_value", F.coalesce("k.observed_value", F.lit("")).alias("observed_value"), "k.status", F.coalesce("k.proofs", F.array().cast(f"array<{schemas.PROOF}>")).alias("proofs"))
    said = lambda kind, column: people.select("mission_id", "candidate_id", "wave", F.lit(kind).alias("kind"), F.posexplode(column).alias("ord", "text"))
    remarks = said("deviation", "c.deviations").unionByName(said("limitation", "c.limitations"))
    page_waves = man.select("mission_id", F.explode("page_waves").alias("url", "wave"))
    waves = man.select("mission_id", F.explode("waves").alias("w")).select("mission_id", "w.*")
    return Corpus(missions, requirements, criteria, remarks, pages.join(page_waves, ["mission_id", "url"], "left"), waves, broken.unionByName(problems(man, audits, one, pages, page_waves, requirements, criteria, waves)))


def typed(columns: str) -> str:
    """Columns of a table schema as fields of a struct."""
    import re

    return ",".join(re.sub(r"^(\w+) ", r"\1:", part.strip()) for part in re.split(r",\s(?=\w+ )", columns))


def problems(man: DataFrame, audits: DataFrame, one: DataFrame, pages: DataFrame, page_waves: DataFrame, requirements: DataFrame, criteria: DataFrame, waves: DataFrame) -> DataFrame:
    """What is wrong with corpora: mission_id, problem."""
    say = lambda df, what: df.select("mission_id", F.lit(what).alias("problem"))
    from pyspark.sql.window import Window

    known = page_waves.select("mission_id", canonical_url("url").alias("u"), F.col("wave").alias("page_wave"))
    late = one.withColumn("u", canonical_url("page_url")).join(known, ["mission_id", "u"], "left").filter("page_wave IS NULL OR page_wave > wave")
    before = Window.partitionBy("mission_id").orderBy("wave")
    steps = waves.withColumn("n", F.row_number().over(before)).withColumn("last_queries", F.lag("logical_queries_before_near_miss").over(before)).withColumn("last_seen", F.lag("seen_signatures_before_near_miss").over(before))
    odd_step = (F.col("n") != F.col("wave")) | (F.col("wave") > 4) | (F.col("logical_queries_before_near_miss") < F.col("logical_queries_at_entry")) | (F.col("logical_queries_at_entry") < F.coalesce("last_queries", F.lit(0))) | (F.col("seen_signatures_at_entry") != F.col("seen_signatures_before_near_miss")) | (F.size(F.array_except(F.coalesce("last_seen", F.array().cast("array<string>")), "seen_signatures_at_entry")) > 0)
    odd_manifest = (F.col("schema_version") != 1) | ~F.col("threshold").between(1, 100) | ~F.col("generated_at").endswith("Z") | F.try_to_timestamp("generated_at").isNull() | ~F.col("code.sha256").rlike("^[0-9a-f]{64}$") | ~F.col("fiche.sha256").rlike("^[0-9a-f]{64}$") | ~F.col("fiche.hash_scope").isin("file_bytes", "extracted_text") | ((F.col("fiche.hash_scope") == "file_bytes") & (F.col("fiche.path") == ""))
    parts = [
        say(man.filter(F.coalesce(odd_manifest, F.lit(True))), "manifest"),
        say(audits.join(man, "mission_id").filter(F.size("audits") != F.size("audit_waves")), "audit_waves"),
        say(pages.join(page_waves, ["mission_id", "url"], "full_outer").filter("content IS NULL OR wave IS NULL"), "page_waves"),
        say(late, "audit before its page"),
        say(steps.filter(odd_step), "waves"),
        say(requirements.groupBy("mission_id", "requirement_id").count().filter("count > 1"), "requirement ids"),
        say(criteria.filter(~F.col("status").isin("proven", "not_proven", "incompatible") | F.exists("proofs", lambda p: ~p["type"].isin("web_officiel", "web_secondaire") | (F.trim(p["excerpt"]) == "") | ~p["url"].rlike("^https?://[^/]"))), "criteria"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def write(corpus: Corpus, manifests: DataFrame, path: str) -> None:
    """Captures missions as tables of JSON texts below `path` (which must not exist): one row a mission for each of the
    four files, as load_tables() takes them. `manifests`: mission_id and the manifest's fields."""
    criterion = F.struct("ord", F.struct("requirement_id", "requested_value", "observed_value", "status", "proofs").alias("c"))
    people = corpus.criteria.groupBy("mission_id", "audit_ord", "candidate_id", "page_url", "brand", "reference").agg(F.transform(F.array_sort(F.collect_list(criterion)), lambda x: x["c"]).alias("criteria"))
    said = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", "text")))), lambda x: x["text"])
    remarks = corpus.remarks.groupBy("mission_id", "candidate_id").agg(said("deviation").alias("deviations"), said("limitation").alias("limitations"))
    none = F.array().cast("array<string>")
    people = people.join(remarks, ["mission_id", "candidate_id"], "left").withColumn("deviations", F.coalesce("deviations", none)).withColumn("limitations", F.coalesce("limitations", none))
    one = people.groupBy("mission_id", "audit_ord", "page_url").agg(F.transform(F.array_sort(F.collect_list(F.struct("candidate_id", F.struct("brand", "reference", "criteria", "deviations", "limitations").alias("c")))), lambda x: x["c"]).alias("candidates"))
    audits = one.groupBy("mission_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("audit_ord", "page_url", "candidates"))), lambda x: F.struct(x["page_url"].alias("page_url"), x["candidates"].alias("candidates")))).alias("value"))
    asked = corpus.requirements.groupBy("mission_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "requirement_id", "label", "requested_value", "critical"))), lambda x: F.struct(x["requirement_id"].alias("id"), x["label"].alias("label"), x["requested_value"].alias("requested_value"), x["critical"].alias("critical"))).alias("criteria"))
    texts = {
        "requirements": corpus.missions.join(asked, "mission_id").select("mission_id", F.to_json(F.struct("product", "origin_brand", "criteria")).alias("value")),
        "audits": audits,
        "pages": corpus.pages.groupBy("mission_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("url", "content")))).alias("value")),
        "manifest": manifests.select("mission_id", F.to_json(F.struct(*[c for c in manifests.columns if c != "mission_id"])).alias("value")),
    }
    for name, rows in texts.items():
        rows.write.mode("errorifexists").parquet(f"{path}/{name}")


def read_captured(spark: SparkSession, path: str) -> Corpus:
    """Corpora that write() has captured."""
    return parse({name: spark.read.parquet(f"{path}/{name}") for name in FILES})
