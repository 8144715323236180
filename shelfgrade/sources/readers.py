"""Readers of snapshots, registries, URL lists, site maps, vocabularies and documents."""
from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions import text as T
from ..functions.lists import extract_and_validate
from ..operators import classify as C
from ..session import spread


class Catalog:
    """Tables of one snapshot folder, read lazily with declared schemas: ``Catalog(spark, dir).part``."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, str] | None = None):
        self.spark, self.root, self._tables = spark, root, schemas.TABLES if tables is None else tables

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._tables:
            raise AttributeError(name)
        return self.spark.read.schema(self._tables[name]).parquet(f"{self.root}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table for costly work on each row, see :func:`shelfgrade.session.spread`."""
        return spread(getattr(self, name))


def load_brands(spark: SparkSession, path: str, max_priority: int | None = None, first: int | None = None) -> DataFrame:
    """Brand records of a JSON array, by priority and slug."""
    d = spark.read.schema(schemas.BRAND).json(path, multiLine=True)
    if max_priority is not None:
        d = d.filter(F.col("priority") <= max_priority)
    d = d.orderBy(F.asc_nulls_last("priority"), "brand_slug")
    return d.limit(first) if first else d


def brand_groups(spark: SparkSession, path: str) -> DataFrame:
    """(group, brand_slug) rows of a JSON object of lists."""
    return group_members(spark.read.text(path, wholetext=True), "value")


def group_members(df: DataFrame, json_col: str) -> DataFrame:
    groups = df.select(F.explode(F.from_json(json_col, "map<string,array<string>>")).alias("brand_group", "m"))
    return groups.select("brand_group", F.explode("m").alias("brand_slug"))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    return url_lines(spark.read.text(path), "value")


def url_lines(df: DataFrame, col: str) -> DataFrame:
    line = T.strip_ws(col)
    return df.select(line.alias("url")).filter((F.col("url") != "") & ~F.startswith("url", F.lit("#")))


def sitemap_to_urls(docs: DataFrame, url: str = "url", xml: str = "xml", depth: int | None = None) -> DataFrame:
    """(sitemap, page_url) of site maps and site-map indexes.

    ``docs`` holds every fetched file by its URL. An index points at other files; following it is a
    self-join, repeated until nothing new is reached, or to ``depth`` levels. Malformed files give nothing.
    """
    entry = r"(?is)<{0}\b[^>]*>.*?<loc>\s*(.*?)\s*</loc>.*?</{0}>"
    own = docs.select(F.col(url).alias("sitemap"), F.explode(
        F.regexp_extract_all(xml, F.lit(entry.format("url")), F.lit(1))).alias("page_url"))
    links = docs.select(F.col(url).alias("parent"), F.explode(
        F.regexp_extract_all(xml, F.lit(entry.format("sitemap")), F.lit(1))).alias("child"))
    links = links.select("parent", T.decode_entities("child").alias("child")).distinct()
    out, reach = own, links
    seen, level = links, 0
    while depth is None or level < depth:
        if depth is None and reach.isEmpty():
            break
        level += 1
        out = out.unionByName(reach.join(own, reach["child"] == own["sitemap"]).select(F.col("parent").alias("sitemap"), "page_url"))
        nxt = links.select(F.col("parent").alias("child"), F.col("child").alias("_next"))
        # Indexes may point in a circle: a pair is followed once.
        reach = reach.join(nxt, "child").select("parent", F.col("_next").alias("child")).distinct().join(seen, ["parent", "child"], "left_anti")
        seen = seen.union(reach)
    return out.select("sitemap", T.decode_entities("page_url").alias("page_url")).distinct()


def _yaml(spark: SparkSession, path: str | Path) -> dict:
    """A configuration file, read through Spark so that shared storage works."""
    return yaml.safe_load("\n".join(r["value"] for r in spark.read.text(str(path), wholetext=True).collect())) or {}


def load_vocab(path: str | Path, keys: tuple[str, ...] = ("keywords", "keywords_pt", "keywords_en")) -> list[tuple[str, list[str]]]:
    """Ordered (label, words) rules of a vocabulary file; order of the file is the rank."""
    data = _yaml(SparkSession.active(), path)
    data = data.get("seals", data)
    return [(label, [str(w).lower() for k in keys for w in (entry.get(k) or [])]) for label, entry in data.items()]


def vocab_table(spark: SparkSession, rules: list[tuple[str, list[str]]]) -> DataFrame:
    rows = [(i, label, w) for i, (label, words) in enumerate(rules) for w in words]
    return spark.createDataFrame(rows, "rank INT, label STRING, keyword STRING")


def load_allergens(path: str | Path) -> list[tuple[str, str, list[str]]]:
    data = _yaml(SparkSession.active(), path)
    return [(cls, cfg.get("severity", "info"), [str(n) for n in cfg.get("names") or []]) for cls, cfg in data.items()]


def allergen_index(classes: DataFrame) -> DataFrame:
    """Entry -> class from (rank, allergen_class, severity, name) rows; the first class keeps an entry."""
    d = classes.withColumn("entry", T.norm_entry("name")).filter(F.col("entry") != "")
    return d.groupBy("entry").agg(F.min_by(F.struct("allergen_class", "severity"), F.struct("rank", "allergen_class")).alias("c")).select("entry", "c.*")


def load_rules(df: DataFrame, json_col: str) -> DataFrame:
    """Nested category -> profile -> {score, reason} JSON to long form."""
    kind = "map<string,struct<by_hair_type:map<string,struct<score:int,reason:string>>>>"
    cats = df.select(F.explode(F.from_json(json_col, kind)).alias("category", "c"))
    return cats.select("category", F.explode("c.by_hair_type").alias("hair_type", "r")).select("category", "hair_type", "r.score", "r.reason")


RECIPE = (
    "brand_slug STRING, allowed_domains ARRAY<STRING>, entrypoints ARRAY<STRING>, "
    "discovery STRUCT<sitemap_urls: ARRAY<STRING>, product_url_pattern: STRING, max_pages: INT, url_blocklist: ARRAY<STRING>>, "
    "extraction STRUCT<name_selectors: ARRAY<STRING>, inci_selectors: ARRAY<STRING>, image_selectors: ARRAY<STRING>, "
    "price_selectors: ARRAY<STRING>, description_selectors: ARRAY<STRING>, section_label_map: MAP<STRING, ARRAY<STRING>>>"
)


def load_recipes(spark: SparkSession, folder: str | Path) -> DataFrame:
    """One row per brand recipe file. The folder is configuration: one small file per brand."""
    def strings(x) -> list[str]:
        return [s for s in (x or []) if isinstance(s, str)]

    rows = []
    files = spark.read.text(f"{folder}/*.y*ml", wholetext=True).select(F.input_file_name().alias("path"), "value")
    for path, text in sorted(map(tuple, files.collect())):
        r = yaml.safe_load(text) or {}
        d, e = r.get("discovery") or {}, r.get("extraction") or {}
        labels = {k: strings((v or {}).get("labels")) for k, v in (e.get("section_label_map") or {}).items()}
        rows.append((
            r.get("brand_slug", Path(path).stem), strings(r.get("allowed_domains")), strings(r.get("entrypoints")),
            (strings(d.get("sitemap_urls")), d.get("product_url_pattern"), d.get("max_pages"), strings(d.get("url_blocklist"))),
            (*[strings(e.get(k)) for k in ("name_selectors", "inci_selectors", "image_selectors", "price_selectors", "description_selectors")], labels)))
    return spark.createDataFrame(rows, RECIPE)


# --- documents ------------------------------------------------------------------------------

def ingest_documents(files: DataFrame, path: str, content: str, skip_prefixes: tuple[str, ...] = ("_", ".")) -> DataFrame:
    """(source, content, char_count, token_estimate) of text files; hidden, empty and repeated sources go."""
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[A-Za-z0-9]+$", "")
    d = files.select(name.alias("source"), T.clean_doc_text(content).alias("content"))
    skipped = C.any_prefix("source", skip_prefixes)
    d = d.filter((F.coalesce(F.col("content"), F.lit("")) != "") & ~skipped)
    one = d.groupBy("source").agg(F.min_by("content", F.struct(F.length("content"), "content")).alias("content"))
    return one.withColumns({"char_count": F.length("content"), "token_estimate": F.floor(F.length("content") / 4)})


def read_documents(spark: SparkSession, glob: str) -> DataFrame:
    files = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return ingest_documents(files, "path", "value")


def sync_documents(target: DataFrame, batch: DataFrame, replace: bool = False) -> DataFrame:
    """Upsert by source; with ``replace`` sources missing from the batch go."""
    b = batch.select("source", F.col("content").alias("_c"))
    j = target.join(b, "source", "right" if replace else "full")
    return j.select("source", F.coalesce("_c", "content").alias("content"), F.col("_c").isNotNull().alias("touched"))


def assemble_context(docs: DataFrame, source: str = "source", content: str = "content") -> DataFrame:
    """The context as ordered pieces: (source, piece, char_count). Sort by source and write or stream it.

    The pieces joined in order are the whole context; it is never held in one row.
    """
    piece = F.concat(F.lit("## "), F.col(source), F.lit("\n\n"), F.col(content), F.lit("\n\n"))
    return docs.select(F.col(source).alias("source"), piece.alias("piece")).withColumn("char_count", F.length("piece")).orderBy("source")


# Texts that betray serialised JSON in an ingredient field.
JSON_MARKS = [
    '"@type"', '"@context"', '"@graph"', '"contactPoint"', '"telephone"', '"availableLanguage"', '"areaServed"',
    '"streetAddress"', '"postalCode"', "application/ld+json",
]


def garbage_list_text(text: Column | str) -> Column:
    """Too short, marked as JSON, or more than 2 % braces and brackets."""
    s = F.coalesce(T._c(text), F.lit(""))
    braces = F.length(s) - F.length(F.regexp_replace(s, r"[\[\]{}]", ""))
    return (F.length(s) < 10) | T.contains_any(s, JSON_MARKS) | (braces / F.greatest(F.length(s), F.lit(1)) > 0.02)


def ingest_items(items: DataFrame, text: str, rules=None) -> DataFrame:
    """Item feed to product rows: list, status, confidence; serialised JSON counts as no list."""
    from ..functions.lists import DEFAULT_RULES

    clean = F.when(garbage_list_text(text), F.lit("")).otherwise(F.col(text))
    d = items.withColumn("_v", extract_and_validate(clean, False, rules or DEFAULT_RULES))
    ok = F.col("_v.valid")
    return d.withColumns({
        "inci_ingredients": F.when(ok, F.col("_v.cleaned")),
        "verification_status": F.when(ok, "verified_inci").otherwise("catalog_only"),
        "confidence": F.when(ok, 0.7).otherwise(0.4),
    }).drop("_v")


