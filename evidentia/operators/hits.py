"""Search hits: engine rotation, relevance, and a fair choice of pages. Native windows and arrays."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import kernels as k
from evidentia.functions import scan
from evidentia.functions.urls import canonical_url, is_list_page, is_off_topic, is_usable

HITS, ATTEMPTS = 12, 3
# Words of a query that don't tell one product from another.
GENERIC = frozenset("catalogue caracteristiques comparison comparaison constructeur datasheet documentation equivalent fiche manufacturer produit product specifications technique technical".split())
ENGINE_GENERIC = frozenset("catalogue caracteristiques datasheet documentation fiche product produit specification specifications technique technical contacteur disjoncteur relais interrupteur variateur industriel industrial".split())
JOINTS = "-_./×"  # of a hit's words


def words_of(text: str) -> list[str]:
    return [c for c, _, _ in scan.codes(text, JOINTS)]


def anchors_of(text: str) -> list[str]:
    """Runs of four digits or more that stand alone."""
    return [c for c, _, _ in scan.codes(text, "") if c.isdigit() and len(c) >= 4]


def has_any_anchor(text: str, anchors: list[str]) -> bool:
    return any(c.startswith(a) for c, _, _ in scan.codes(text.casefold(), "") for a in anchors)


def numeric_anchors(query: Column) -> Column:
    """Distinct runs of four digits or more that stand alone."""
    runs = F.regexp_extract_all(query, F.lit("[A-Za-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(runs, lambda r: r.rlike("^[0-9]{4,}$")))


def has_anchor(text: Column, anchors: Column) -> Column:
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.exists(tokens, lambda t: F.exists(anchors, lambda a: t.startswith(a)))


def engine_sequence(engines: list[str], offset: Column) -> Column:
    """The engines from a rotating start."""
    all_ = F.array(*map(F.lit, engines))
    start = F.pmod(offset, F.lit(len(engines)))
    return F.concat(F.slice(all_, start + 1, len(engines)), F.slice(all_, 1, start))


def bang_query(shortcut: Column, query: Column) -> Column:
    """The query with exactly one engine mark in front."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(query, r"(?:^|(?<=\s))!\S+", ""), r"\s+", " "))
    return F.rtrim(F.concat(F.lit("!"), shortcut, F.lit(" "), plain))


def tokens(text: str, generic: frozenset[str] | None) -> set[str]:
    keys = {k.folded_key(t) for t in words_of(text)}
    return keys if generic is None else {t for t in keys if len(t) >= 4 and t not in generic}


def matches_query(url: str, title: str, snippet: str, query: str) -> bool:
    """Does an engine's hit take up the query: a number of it, or two of its telling words?"""
    text = "\n".join((url or "", title or "", snippet or ""))
    if anchors := anchors_of(query or ""):
        return has_any_anchor(text, anchors)
    wanted = tokens(query or "", ENGINE_GENERIC)
    return len(wanted) < 2 or len(wanted & tokens(text, None)) >= 2


def matches_context(url: str, title: str, snippet: str, query: str, references: list | None) -> bool:
    """Is a hit worth opening: it has a sought reference; or a number, a code or two words of the query; or nothing can be told?"""
    from urllib.parse import unquote

    text = "\n".join((unquote(url or ""), title or "", snippet or ""))
    key = k.folded_key(text)
    if references:
        return any(len(r) >= 4 and r in key for r in references)
    if anchors := anchors_of(query or ""):
        return has_any_anchor(text, anchors)
    wanted = tokens(query or "", GENERIC)
    codes = {k.folded_key(t) for t in words_of(query or "") if re.search(r"\d\d", t) and len(k.folded_key(t)) >= 4}
    if codes:
        words = re.findall("[a-z0-9]+", k.unaccented(text).casefold())
        return any(c in key for c in codes) or any(w.startswith(a) for a in wanted if not re.search(r"\d", a) for w in words)
    if len(wanted) < 2 or len(tokens(f"{title or ''}\n{snippet or ''}", GENERIC)) < 2:
        return True
    return len(wanted & tokens(text, None)) >= 2


def normalize_hits(results: DataFrame) -> DataFrame:
    """Raw results (mission_id, wave, query_ord, query, engine, called_engine, position, url, title, snippet) of the called
    engine with a URL, trimmed, ranked 1 to HITS."""
    url = F.trim(F.coalesce("url", F.lit("")))
    order = Window.partitionBy("mission_id", "wave", "query_ord", "engine").orderBy("position")
    rows = results.filter((F.col("engine") == F.col("called_engine")) & (url != "")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= HITS)
    return rows.select("mission_id", "wave", "query_ord", "query", "engine", "rank", url.alias("url"), F.trim(F.coalesce("title", F.lit(""))).alias("title"), F.trim(F.coalesce("snippet", F.lit(""))).alias("snippet"))


def first_relevant_engine(hits: DataFrame) -> DataFrame:
    """Of each query the hits of the first attempted engine that has a relevant one; `hits` also has attempt (1 to ATTEMPTS)."""
    relevant = k.udf(matches_query, "boolean")("url", "title", "snippet", "query")
    per = Window.partitionBy("mission_id", "wave", "query_ord")
    rows = hits.filter(F.col("attempt") <= ATTEMPTS).withColumn("_r", relevant).withColumn("_a", F.min(F.when(F.col("_r"), F.col("attempt"))).over(per))
    return rows.filter("attempt = _a AND _r").drop("_r", "_a")


def select_pages(hits: DataFrame, seen: DataFrame | None, limit: int) -> DataFrame:
    """mission_id, url, canonical, queries, references, position: the pages to open next, at most `limit` a mission (0: all).

    `hits`: mission_id, query_ord, query, rank, url, title, snippet, references (array, null for open search). Pages are
    taken by rank, then by query, each canonical URL once with the contexts of all its hits."""
    ok = is_usable(F.col("url")) & ~is_list_page(F.col("url")) & ~is_off_topic(F.col("url"))
    rows = hits.filter(ok).filter(k.udf(matches_context, "boolean")("url", "title", "snippet", "query", "references")).withColumn("canonical", canonical_url("url"))
    if seen is not None:
        rows = rows.join(seen.select("mission_id", F.col("url").alias("canonical")), ["mission_id", "canonical"], "left_anti")
    at = F.struct("query_ord", "rank")
    merged = rows.groupBy("mission_id", "canonical").agg(F.min_by("url", at).alias("url"), F.min(F.struct("rank", "query_ord")).alias("_o"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("query_ord", "rank", "query"))), lambda x: x["query"])).alias("queries"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("references", F.array().cast("array<string>"))))).alias("references"))
    order = Window.partitionBy("mission_id").orderBy("_o.rank", "_o.query_ord", "canonical")
    out = merged.withColumn("position", F.row_number().over(order)).drop("_o")
    return out.filter(F.col("position") <= limit) if limit else out


def merge_redirects(selected: DataFrame, pages: DataFrame, done: DataFrame) -> DataFrame:
    """Selected pages grouped by the URL that their fetch ended at, without those done before; contexts united in order."""
    rows = selected.join(pages.select("mission_id", F.col("requested").alias("url"), F.col("url").alias("final_url"), "content"), ["mission_id", "url"]).withColumn("final", canonical_url("final_url"))
    rows = rows.join(done.select("mission_id", F.col("url").alias("final")), ["mission_id", "final"], "left_anti")
    united = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", c))), lambda x: x[c])))
    return rows.groupBy("mission_id", "final").agg(F.min_by("final_url", "position").alias("url"), F.min_by("content", "position").alias("content"), united("queries").alias("queries"), united("references").alias("references"), F.min("position").alias("position"))


def readable_or_lists(urls: DataFrame, limit: int) -> DataFrame:
    """Readable URLs of each query that aren't lists; where there are none, its readable lists; at most `limit`."""
    from evidentia.functions.urls import is_readable

    rows = urls.filter(is_readable(F.col("url"))).withColumn("_list", is_list_page(F.col("url")))
    per = Window.partitionBy("query")
    rows = rows.withColumn("_any", F.min(F.col("_list").cast("int")).over(per)).filter((F.col("_any") == 1) | ~F.col("_list"))
    return rows.withColumn("position", F.row_number().over(per.orderBy("ord"))).filter(F.col("position") <= limit).drop("_list", "_any")


def without_origin(query: str, origin: str) -> str:
    """A query without the origin's words and the single letters they leave alone; unchanged if fewer than three words stay."""
    banned = {w for w in k.ascii_words(origin) if w not in ENGINE_GENERIC and len(w) > 1}
    words = (query or "").split()
    kept = [w for w in words if not banned & set(k.ascii_words(w))]
    if len(kept) < len(words):
        kept = [w for w in kept if len(w) > 1 or w.isdigit()]
    return " ".join(kept) if len(kept) >= 3 else " ".join(words)


def tidy_query(text: str) -> str:
    """The last line with text, its first 16 words."""
    lines = [x for x in (text or "").splitlines() if x.strip()]
    return " ".join(lines[-1].strip(" \"'`").split()[:16]) if lines else ""


def with_brand(query: Column, brand: Column) -> Column:
    return F.when((F.trim(F.coalesce(brand, F.lit(""))) == "") | F.contains(F.lower(query), F.lower(F.trim(brand))), query).otherwise(F.concat_ws(" ", F.trim(brand), query))


def interleave(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two ordered lists of queries (mission_id, position, query) in turn."""
    both = left.withColumn("_s", F.lit(0)).unionByName(right.withColumn("_s", F.lit(1)))
    order = Window.partitionBy("mission_id").orderBy("position", "_s")
    return both.withColumn("position", F.row_number().over(order)).drop("_s")
