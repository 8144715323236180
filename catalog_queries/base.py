"""Registry of queries, and the roles the driver tables play."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfgrade.sources.readers import Catalog

QUERIES: dict[str, Callable[[Catalog], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Catalog], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: fn(Catalog(spark, sf_dir))

    return {name: bind(fn) for name, fn in QUERIES.items()}


# --- products: part, with a document as description ---------------------------------------

PRODUCT = {
    "product_id": "p_partkey",
    "brand_slug": "lower(replace(p_brand, '#', '-'))",
    "product_name": "p_name || CASE WHEN p_size <= 40 THEN ' ' || CAST(p_size AS STRING) || 'ml' ELSE '' END",
    "size_volume": "CASE WHEN p_size <= 40 THEN CAST(p_size AS STRING) || 'ml' END",
    "product_url": "'https://' || lower(replace(p_brand, '#', '-')) || '.example.com/products/' || replace(p_name, ' ', '-') || '-' || CAST(p_size AS STRING)",
    "verification_status": "CASE p_type WHEN 'ECONOMY' THEN 'quarantined' WHEN 'STANDARD' THEN 'catalog_only' WHEN 'LARGE' THEN 'catalog_only' ELSE 'verified_inci' END",
    "product_type": "CASE WHEN p_size < 48 THEN lower(p_type) END",
    "product_category": "CASE WHEN p_size = 50 THEN NULL WHEN p_name LIKE '%gizmo' THEN 'non_hair' ELSE lower(p_type) END",
    "price": "CASE WHEN p_size <> 13 THEN p_retailprice END",
    "currency": "CASE WHEN p_size <> 14 THEN 'BRL' END",
    "is_kit": "p_name LIKE 'large %'",
    "is_hidden": "p_size = 49",
    "confidence": "p_size * 2.0E0",
    "gold_status": "CASE WHEN p_size > 40 THEN 'raw' WHEN p_size > 30 THEN 'catalog' WHEN p_size > 20 THEN 'gold' WHEN p_size > 15 THEN 'gold_candidate' ELSE 'catalog' END",
    "status_editorial": "CASE WHEN p_size < 10 THEN 'pendente' WHEN p_size < 20 THEN 'em_revisao' WHEN p_size < 35 THEN 'aprovado' WHEN p_size < 42 THEN 'corrigido' ELSE 'rejeitado' END",
    "status_publicacao": "CASE WHEN p_size < 30 THEN 'publicado' ELSE 'rascunho' END",
    "image_url_main": "CASE WHEN p_size <> 7 THEN 'https://img.example.com/' || CAST(p_partkey AS STRING) || '.jpg' END",
    "ean": "CASE WHEN p_size > 5 THEN '789-' || CAST(1000000 + p_partkey AS STRING) END",
    "created": "CAST(p_retailprice * 100 AS BIGINT)",
}
_EXPRS = ", ".join(f"{e} AS {n}" for n, e in PRODUCT.items())
PRODUCTS_SQL = f"products AS (SELECT {_EXPRS} FROM part)"
DESCRIBED_SQL = f"products AS (SELECT {_EXPRS}, text AS description FROM part LEFT JOIN documents ON doc_id = p_partkey)"


def products(t: Catalog, described: bool = False, spread: bool = False) -> DataFrame:
    exprs = [f"{e} AS {n}" for n, e in PRODUCT.items()]
    if not described:
        return (t.spread("part") if spread else t.part).selectExpr(*exprs)
    joined = t.part.join(t.documents, F.col("doc_id") == F.col("p_partkey"), "left")
    return joined.selectExpr(*exprs, "text AS description")


# --- ordered lists: lineitem ----------------------------------------------------------------

BRIDGE_SQL = "bridge AS (SELECT l_orderkey AS product_id, l_partkey AS ingredient_id, l_linenumber AS position, l_suppkey AS tie FROM lineitem)"
INGREDIENTS_SQL = "ingredients AS (SELECT p_partkey AS ingredient_id, p_name AS canonical_name, CASE WHEN p_size <= 45 THEN p_type END AS category FROM part)"


def bridge(t: Catalog) -> DataFrame:
    return t.lineitem.selectExpr("l_orderkey AS product_id", "l_partkey AS ingredient_id", "l_linenumber AS position", "l_suppkey AS tie")


def ingredients(t: Catalog) -> DataFrame:
    return t.part.selectExpr("p_partkey AS ingredient_id", "p_name AS canonical_name", "CASE WHEN p_size <= 45 THEN p_type END AS category")


# --- documents as products with their own text lists ---------------------------------------

DOC = {
    "product_id": "doc_id", "brand_slug": "source", "product_category": "lang", "description": "text",
    "product_name": "replace(substring(text, 1, 40), chr(10), ' ')",
    "product_url": "'https://' || source || '.example.com/p/' || CAST(doc_id AS STRING)",
    "image_url_main": "CASE WHEN lang <> 'es' THEN 'https://img.example.com/' || CAST(doc_id AS STRING) END",
    "status": "CASE WHEN n_chars < 200 THEN 'quarantined' WHEN n_chars < 1500 THEN 'catalog_only' ELSE 'verified_inci' END",
}
DOCS_SQL = "docs AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in DOC.items()) + ", n_chars FROM documents)"


def docs(t: Catalog) -> DataFrame:
    return t.documents.selectExpr(*[f"{e} AS {n}" for n, e in DOC.items()], "n_chars")
