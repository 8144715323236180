"""Line dedup: keep bitmaps per document instead of text. DataFrame functions only.

Method: lines become 128-bit hashes of their keys, range-partitioned by (hash, document, position)
and sorted, so that even one very frequent line is spread over many partitions. Each partition
streams its first occurrences; a second, small aggregate joins the pieces of a key. What is
returned per document is a sparse bitmap of lines to drop, at most one 64-bit word per 64 lines.

Defined results: a null or empty text is one empty line and is kept. Keys shorter than
``min_chars`` are always kept. Repeated rows with the same id count as one document. Rows with a
null id count as one document that comes after all others. Rows with the same id and different
texts get bitmaps of their own (``text_hash``). Extra columns are ignored. An empty table gives an
empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfgrade.llm.common import BLANKS, ascii_lower, packed, unpacked


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased."""
    return ascii_lower(stripped(line))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _stays(bits: Column, i: Column) -> Column:
    word = F.coalesce(F.element_at(bits, F.shiftright(i, 6).cast("long")), F.lit(0).cast("long"))
    return F.call_function("shiftright", word, i.bitwiseAND(63)).bitwiseAND(1) == 0


def drop_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10,
                 partitions: int | None = None) -> DataFrame:
    """``(doc, text_hash, words)`` for the documents that lose lines.

    ``words`` is an ordered array of ``(word, bits)``: bit ``p % 64`` of word ``p / 64`` is set where
    line ``p`` goes. Words without a set bit are left out.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = (docs.select(F.col(id_col).alias("doc"), text_hash(F.col(text_col)).alias("th"), F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
             .filter(F.length(stripped(F.col("line"))) >= min_chars)
             .select("doc", "th", "pos", line_key(F.col("line")).alias("key"))
             .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "th", "pos"))
    ordered = lines.repartitionByRange(n, "h1", "h2", "doc", "pos").sortWithinPartitions("h1", "h2", "doc", "pos")
    # Both readers of the sorted lines use all their columns, so that Spark makes the exchange once.
    place = F.when(F.col("doc").isNotNull(), F.struct("doc", "pos", "th"))
    first = (ordered.groupBy("h1", "h2")
             .agg(F.min(place)["doc"].alias("lo"), F.max("doc").alias("hi"), F.max(F.col("doc").isNull()).alias("no_id"))
             .filter("lo < hi or (lo is not null and no_id)").select("h1", "h2", "lo"))
    gone = ordered.join(first, ["h1", "h2"]).filter("not (doc <=> lo)")
    words = gone.groupBy("doc", "th", F.expr("pos div 64").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(pos % 64 as int)))").alias("bits"))
    return words.groupBy("doc", F.col("th").alias("text_hash")).agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``, read off the bitmaps. Null texts stay null."""
    b = bitmaps.select(F.col("doc").alias("bdoc"), F.col("text_hash").alias("bth"), "words")
    rows = packed(docs, F.col(id_col).alias("id"), F.col(text_col).alias("body"), text_hash(F.col(text_col)).alias("th"))
    joined = rows.join(b, F.col("id").eqNullSafe(F.col("bdoc")) & (F.col("th") == F.col("bth")), "left")
    bits, text = F.map_from_entries("words"), F.coalesce("body", F.lit(""))
    kept = F.array_join(F.filter(_lines(text), lambda line, i: _stays(bits, i)), "\n")
    return unpacked(
        joined, docs.columns,
        ("n_lines", (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")),
        ("n_dropped", F.coalesce(F.aggregate("words", F.lit(0), lambda acc, w: acc + F.bit_count(w["bits"])), F.lit(0)).cast("long")),
        ("kept_text", F.when(F.col("words").isNull(), F.col("body")).otherwise(kept)))
