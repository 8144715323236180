"""Declared schemas. Nothing is inferred at read time."""
from __future__ import annotations

from pyspark.sql import types as T

# Driver tables used as stand-ins for the catalogue.
TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
}

PRODUCT = (
    "product_id STRING, brand_slug STRING, product_name STRING, product_url STRING, image_url_main STRING, "
    "image_url_front STRING, image_urls_gallery ARRAY<STRING>, verification_status STRING, gold_status STRING, "
    "is_kit BOOLEAN, is_hidden BOOLEAN, product_type_normalized STRING, product_category STRING, gender_target STRING, "
    "relevance_reason STRING, inci_ingredients ARRAY<STRING>, description STRING, usage_instructions STRING, "
    "care_usage STRING, composition STRING, benefits_claims ARRAY<STRING>, size_volume STRING, price DOUBLE, "
    "currency STRING, ean STRING, confidence DOUBLE, extraction_method STRING, hair_type ARRAY<STRING>, "
    "audience_age STRING, function_objective STRING, ph DOUBLE, status_editorial STRING, status_publicacao STRING, "
    "extracted_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP"
)
EVIDENCE = (
    "evidence_id STRING, product_id STRING, field_name STRING, source_url STRING, evidence_locator STRING, "
    "raw_source_text STRING, extraction_method STRING, extracted_at TIMESTAMP"
)
BRAND = (
    "brand_slug STRING, brand_name STRING, official_url_root STRING, country STRING, priority INT, status STRING, "
    "catalog_entrypoints ARRAY<STRING>, notes STRING"
)
EVENT = "event_id STRING, user_id STRING, email STRING, event_type STRING, ip_address STRING, detail STRING, created_at TIMESTAMP"
RETRIEVAL = (
    "log_id STRING, user_id STRING, conversation_id STRING, query_hash STRING, intent STRING, kb_sources ARRAY<STRING>, "
    "chunk_count BIGINT, latency_ms BIGINT, created_at TIMESTAMP"
)
REVISION = (
    "entity_type STRING, entity_id STRING, field_name STRING, old_value STRING, new_value STRING, change_source STRING, created_at TIMESTAMP"
)


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
