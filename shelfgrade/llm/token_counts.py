"""Token counts as delta-maintained rollups.

A rollup is a folder of committed batches. A batch holds signed sums per (source, language, tokenizer version):
inserted documents count positive, deleted ones negative, revised ones with the difference of their new and old
counts. Totals are the sums over all batches, so no batch reads the documents of another.

Commits. A batch is written into a fresh folder and then published by the next manifest, a small file that names the folders which count. A
manifest is put in place by one rename that never replaces another file: of two writers one starts over. A reader takes the newest manifest;
it sees a batch whole or not at all, and a crash before the rename leaves everything as it was. The same batch id again replaces the
batch: a retried or repeated commit changes nothing. ``compact`` folds batches into one and keeps their ids, so that a retry of a
folded batch is ignored. ``sweep`` removes folders that the newest manifest does not name, when no reader needs them.

Counts: ``words`` are the runs of ``[^\\x20\\x09-\\x0D]+``; byte-pair counts are exact, taken per pre-token
and remembered per worker for repeated pre-tokens.

Defined results: a null text has 0 tokens and still counts as a document. Null sources and languages are groups of their own.
Repeated rows each count. Groups whose documents and tokens all went are not listed. Very long texts are counted whole. An empty
batch is committed as empty. Extra columns are ignored.
"""
from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

KEYS = ["source", "lang", "tokenizer"]
#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens remembered per worker, and the longest that are.
REMEMBERED, LONGEST = 500_000, 64


@lru_cache(maxsize=2)
def _encoding(path: str):
    import regex
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), regex.compile(PATTERN), {}


def count_tokens(text: str, path: str) -> int:
    """Number of byte-pair tokens of one text."""
    encoding, pattern, seen = _encoding(path)
    total = 0
    for piece in pattern.findall(text):
        n = seen.get(piece)
        if n is None:
            n = len(encoding.encode_ordinary(piece))
            if len(piece) <= LONGEST:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen[piece] = n
        total += n
    return total


def bpe_count(text: Column, path: str) -> Column:
    """Tokens of a text under a vocabulary file; the path must be readable on every worker."""
    @F.pandas_udf("long")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield pd.Series([count_tokens(t, path) if isinstance(t, str) else 0 for t in s], dtype="int64")

    return run(text)


def counted(docs: DataFrame, tokenizers: dict[str, Column]) -> DataFrame:
    """``(doc_id, source, lang, tokenizer, tokens)``: one row per document and tokenizer version."""
    counts = F.map_from_arrays(F.array(*[F.lit(k) for k in tokenizers]), F.array(*tokenizers.values()))
    return docs.select("doc_id", "source", "lang", F.explode(counts).alias("tokenizer", "tokens"))


def signed(rows: DataFrame, docs: int) -> DataFrame:
    """Delta rows of inserted (``docs`` = 1) or deleted (-1) documents."""
    return rows.select(*KEYS, F.lit(docs).cast("long").alias("docs"), (F.col("tokens") * docs).alias("tokens"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Delta rows of documents whose counts changed; a change of source or language moves them."""
    return signed(old, -1).union(signed(new, 1))


def _file_system(spark: SparkSession, folder: str):
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(conf), jvm


def manifest(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """Number and content of the newest manifest: ``{"batches": {id: sub-folder}, "folded": {id: id of the batch it is in}}``."""
    path, fs, jvm = _file_system(spark, f"{folder}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    newest = max((int(n.split(".")[0]) for n in names if n.endswith(".json") and n.split(".")[0].isdigit()), default=0)
    if not newest:
        return 0, {"batches": {}, "folded": {}}
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(path, f"{newest:012d}.json"))
    try:
        return newest, json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _publish(spark: SparkSession, folder: str, number: int, content: dict) -> bool:
    """Put the manifest of this number in place; False if another writer was first."""
    path, fs, jvm = _file_system(spark, f"{folder}/manifests")
    draft, final = (jvm.org.apache.hadoop.fs.Path(path, n) for n in (f"draft-{uuid.uuid4().hex}", f"{number:012d}.json"))
    stream = fs.create(draft, False)
    stream.write(json.dumps(content, sort_keys=True).encode())
    stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration())
    try:
        # Without the option to overwrite, an existing file makes this fail.
        context.rename(fs.makeQualified(draft), fs.makeQualified(final), options)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception):
            raise
        fs.delete(draft, False)
        return False
    return True


def _put(spark: SparkSession, folder: str, change, sums: DataFrame) -> bool:
    """Write sums into a fresh folder and publish what ``change(content, sub-folder)`` makes of the manifest; None from it leaves all as it is."""
    if change(manifest(spark, folder)[1], "") is None:
        return False
    name = f"data-{uuid.uuid4().hex}"
    sums.write.parquet(f"{folder}/{name}")
    while True:
        number, content = manifest(spark, folder)
        content = change(content, name)
        if content is None:
            return False
        if _publish(spark, folder, number + 1, content):
            return True


def commit(folder: str, batch_id: str, deltas: DataFrame) -> bool:
    """Write one batch's signed sums. The same id again replaces them; False if the batch has been folded already."""
    sums = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 or tokens <> 0")

    def change(content: dict, name: str) -> dict | None:
        return None if batch_id in content["folded"] else content | {"batches": content["batches"] | {batch_id: name}}

    return _put(deltas.sparkSession, folder, change, sums)


def _sums(spark: SparkSession, folder: str, content: dict) -> DataFrame:
    schema = "source string, lang string, tokenizer string, docs long, tokens long"
    paths = [f"{folder}/{name}" for name in sorted(content["batches"].values())]
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 or tokens <> 0")


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """``(source, lang, tokenizer, docs, tokens)`` over all batches of the newest manifest."""
    return _sums(spark, folder, manifest(spark, folder)[1])


def compact(spark: SparkSession, folder: str, into: str | None = None, batch_id: str = "all") -> None:
    """The batches that are there as one, in the same or in another folder, which keeps their ids.

    Batches that arrive meanwhile stay by themselves; where one that is being folded is replaced meanwhile, the folding starts over.
    """
    done = False
    while not done:
        _, source = manifest(spark, folder)
        ids = {*source["batches"], *source["folded"]} - {batch_id}

        def change(content: dict, name: str, source: dict = source, ids: set = ids) -> dict | None:
            if into:
                held = (ids & content["batches"].keys()) | {b for b in ids if content["folded"].get(b, batch_id) != batch_id}
                if held:
                    raise ValueError(f"{into} holds these batches already: {sorted(held)[:5]}")
                rest = content["batches"]
            else:
                if any(content["batches"].get(b) != n for b, n in source["batches"].items()):
                    return None
                rest = {b: n for b, n in content["batches"].items() if b not in source["batches"]}
            return {"batches": rest | {batch_id: name}, "folded": content["folded"] | dict.fromkeys(ids, batch_id)}

        done = _put(spark, into or folder, change, _sums(spark, folder, source))


def sweep(spark: SparkSession, folder: str) -> int:
    """Remove data that the newest manifest does not name and older manifests; the number of things removed."""
    number, content = manifest(spark, folder)
    path, fs, jvm = _file_system(spark, folder)
    if not fs.exists(path):
        return 0
    there = [s.getPath() for s in fs.listStatus(path)] + [s.getPath() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(path, "manifests"))]
    keep = {*content["batches"].values(), f"{number:012d}.json", "manifests"}
    gone = [p for p in there if p.getName() not in keep and not p.getName().startswith(".")]
    for p in gone:
        fs.delete(p, True)
    return len(gone)
