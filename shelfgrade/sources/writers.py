"""Exports, copies and their checks."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators.merges import insert_if_absent

EXPORT_COLUMNS = [
    "product_id", "brand_slug", "product_name", "product_url", "verification_status", "product_type_normalized",
    "product_category", "gender_target", "inci_ingredients", "description", "usage_instructions", "composition",
    "benefits_claims", "size_volume", "price", "currency", "confidence", "extraction_method", "image_url_main", "extracted_at",
]


def flat_lists(df: DataFrame) -> DataFrame:
    """Array and struct columns as JSON text, as a CSV file needs them."""
    nested = [c for c, t in df.dtypes if t.startswith(("array", "struct", "map"))]
    return df.withColumns({c: F.to_json(c) for c in nested})


def export_products(df: DataFrame, key: str, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    """The export rows: fixed columns, key order; all of them, or one page of ``limit`` rows."""
    rows = flat_lists(df.select(*columns)).orderBy(key)
    return rows if limit is None else rows.limit(limit)


def write_export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    if fmt == "csv":
        df.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)
    elif fmt == "json":
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown export format: {fmt}")


def export_grouped(df: DataFrame, brand: str | None, items: str, labels: str) -> DataFrame:
    """Unquarantined rows by category, type and name with the list's size and text and the seals as text."""
    d = df.filter(F.col("verification_status") != "quarantined")
    d = d.filter(F.col("brand_slug") == brand) if brand else d
    return d.withColumns({
        "list_size": F.coalesce(F.size(items), F.lit(0)), "list_text": F.array_join(items, ", "), "label_text": F.array_join(labels, "; "),
    }).drop(items, labels).orderBy("product_category", "product_type_normalized", "product_name")


def append_rows(df: DataFrame, path: str, column: str | None = None, allowed: Sequence[str] = ()) -> None:
    """Append rows whose value is allowed, e.g. feedback with rating up or down."""
    valid_rows(df, column, allowed).write.mode("append").parquet(path)


def valid_rows(df: DataFrame, column: str | None, allowed: Sequence[str]) -> DataFrame:
    return df.filter(F.col(column).isin(*allowed)) if column else df


def split_tables(tables: dict[str, DataFrame], routing: dict[str, str], zones: dict[str, dict[str, DataFrame]], keys: dict[str, str]) -> dict[str, dict[str, DataFrame]]:
    """Tables routed to zones; rows a zone already has are not copied again."""
    out: dict[str, dict[str, DataFrame]] = {}
    for name, df in tables.items():
        zone = routing[name]
        have = zones.get(zone, {}).get(name)
        out.setdefault(zone, {})[name] = df if have is None else insert_if_absent(have, df, [keys[name]])
    return out


def key_digest(df: DataFrame, key: str) -> DataFrame:
    """(rows, digest): an order-free digest of the keys, added up per task."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64(key)).alias("digest"),
                  F.sum(F.pmod(F.xxhash64(key), F.lit(1_000_003))).alias("checksum"))


def verify_copy(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """(source_rows, target_rows, verdict): ok when equal, warn when the target has more, fail otherwise."""
    one = F.lit(1).alias("_k")
    s, t = key_digest(source, key).select(one, F.struct("*").alias("s")), key_digest(target, key).select(one, F.struct("*").alias("t"))
    same = (F.col("s.digest").eqNullSafe(F.col("t.digest"))) & (F.col("s.checksum").eqNullSafe(F.col("t.checksum")))
    return s.join(t, "_k").select(
        F.col("s.rows").alias("source_rows"), F.col("t.rows").alias("target_rows"),
        F.when((F.col("s.rows") == F.col("t.rows")) & same, "ok").when(F.col("t.rows") > F.col("s.rows"), "warn").otherwise("fail").alias("verdict"))


def table_status(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("rows")) for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
