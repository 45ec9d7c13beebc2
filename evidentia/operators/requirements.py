"""Requirements completed from their datasheet: supplements for what is uncovered, and the product's kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import kernels as k
from evidentia.functions import scan
from evidentia.operators.coverage import GENERAL, specifications

SHORT_LABEL = 5  # letters that a label needs to count as part of another


def key(c: Column) -> Column:
    return k.udf(k.ascii_key, "string")(c)


def compatible(a: Column, b: Column) -> Column:
    """Is the shorter of two label keys, long enough, part of the longer?"""
    return (F.least(F.length(a), F.length(b)) >= SHORT_LABEL) & (F.contains(a, b) | F.contains(b, a))


def geometry(body: Column) -> Column:
    """The box and column edges of a table's text, null where any number is broken."""
    box = F.transform(F.split(F.regexp_extract(body, r"\[GEOMETRY bbox=([^ \]]*)", 1), ","), lambda x: x.try_cast("double"))
    edges = F.transform(F.split(F.regexp_extract(body, r"\[GEOMETRY bbox=[^ \]]* columns=([^\]]*)", 1), ";"), lambda c: F.transform(F.split(c, ":"), lambda x: x.try_cast("double")))
    whole = (F.size(box) == 4) & F.forall(box, lambda x: x.isNotNull()) & F.forall(edges, lambda e: (F.size(e) == 2) & F.forall(e, lambda x: x.isNotNull()))
    return F.when(whole, F.struct(box.alias("bbox"), edges.alias("columns")))


def supplemented(requirements: DataFrame, supplement: DataFrame, orphans: DataFrame, sheets: DataFrame, located: bool = False) -> DataFrame:
    """requirements and those of a supplement that the datasheet bears out: an uncovered value, literal in the sheet and in its
    quotation, under a compatible label, and with `located` in the same place. Known ids and values are left out.

    `supplement`: mission_id, ord, requirement_id, label, requested_value, critical, evidence_excerpt, page, table, col;
    `orphans`: mission_id, value, label, reason, page, table, col; `sheets`: mission_id, sheet."""
    open_ = orphans.filter(F.col("reason").isin("missing_spec", "missing_categorical_spec") & (F.col("value") != "")).select("mission_id", key(F.col("value")).alias("value_key"), key(F.col("label")).alias("orphan_label"), *[F.col(c).alias(f"o_{c}") for c in ("page", "table", "col")])
    rows = supplement.withColumns({"value_key": key(F.col("requested_value")), "label_key": key(F.col("label")), "excerpt_key": key(F.col("evidence_excerpt"))}).filter("value_key != ''")
    rows = rows.join(sheets.select("mission_id", key(F.col("sheet")).alias("sheet_key")), "mission_id").filter(F.contains("sheet_key", F.col("value_key")) & F.contains("excerpt_key", F.col("value_key"))).drop("sheet_key")
    place = lambda c: F.col(f"o_{c}").isNull() | (F.col(f"o_{c}") == F.col(c))
    matched = rows.join(open_, ["mission_id", "value_key"]).filter(compatible(F.col("label_key"), F.col("orphan_label")))
    if located:
        matched = matched.filter(place("page") & place("table") & place("col"))
    new = matched.select(*rows.columns).dropDuplicates(["mission_id", "ord"])
    new = new.join(requirements.select("mission_id", "requirement_id"), ["mission_id", "requirement_id"], "left_anti")
    new = new.join(requirements.select("mission_id", key(F.col("requested_value")).alias("value_key")), ["mission_id", "value_key"], "left_anti")
    for by in ("requirement_id", "value_key"):  # the first of each
        new = new.withColumn("_n", F.row_number().over(Window.partitionBy("mission_id", by).orderBy("ord"))).filter("_n = 1").drop("_n")
    last = requirements.groupBy("mission_id").agg(F.max("ord").alias("last"))
    new = new.join(last, "mission_id", "left").withColumn("ord", (F.coalesce("last", F.lit(-1)) + F.row_number().over(Window.partitionBy("mission_id").orderBy("ord"))).cast("int"))
    return requirements.unionByName(new.select(*requirements.columns))


def orphan_text(orphans: DataFrame) -> DataFrame:
    """mission_id, text: uncovered values by line with their label and place, for a second reading."""
    line = F.concat_ws(" ", F.concat("label", F.lit(":")), "value", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"({c} "), F.col(c).cast("string"), F.lit(")"))) for c in ("page", "table", "col")])
    return orphans.groupBy("mission_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def needs_pictures(orphans: DataFrame, missions: DataFrame) -> DataFrame:
    """missions (mission_id, source_path) that are PDF files with uncovered values."""
    pdf = missions.filter(F.lower(F.coalesce("source_path", F.lit(""))).endswith(".pdf"))
    return pdf.join(orphans.select("mission_id").distinct(), "mission_id", "left_semi")


def described_product(product: str | None, sheet: str | None) -> str | None:
    """A product that is a mere code, with the describing line next to it in the sheet: below it, else above."""
    name = (product or "").strip()
    if not name or [c for c, _, _ in scan.codes(name, "-_")] != [name] or not scan.mixed(name):
        return product
    lines = [line.strip() for line in (sheet or "").splitlines()]
    for at in (j for j, line in enumerate(lines) if line == name):
        for line in lines[at + 1 : at + 4] + lines[max(0, at - 3) : at][::-1]:
            if sum(w.isalpha() for w in k.WORD.findall(line)) >= 2 and len(line) <= 160 and ":" not in line and line != line.upper():
                return f"{line} {name}"
    return product


def with_described_products(missions: DataFrame, sheets: DataFrame) -> DataFrame:
    """missions with described products; `sheets`: mission_id, sheet."""
    made = k.udf(described_product, "string")
    return missions.join(sheets.select("mission_id", F.col("sheet").alias("_sheet")), "mission_id", "left").withColumn("product", made("product", "_sheet")).select(*missions.columns)


def covered_by(requirements: DataFrame) -> DataFrame:
    """mission_id, label, keys: the specifications that each requirement states; general ones under GENERAL."""
    return requirements.select("mission_id", F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.lit(GENERAL)).alias("label"), specifications(F.concat_ws(" ", "label", "requested_value")).alias("keys"))
