"""What several operators share: the shared folder, words, hashes of word sequences, connected components.

Words are the runs of ``[^\\x20\\x09-\\x0D]+``. ``bytes.split()`` cuts at exactly these six bytes.
"""
from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfgrade.session import shared_folder

#: The six blank bytes.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows of an Arrow batch: rows hold whole texts here, and a worker holds a few batches at once.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000


def ready(spark: SparkSession) -> SparkSession:
    """The session with a checkpoint folder and Arrow batches of at most ``BATCH_ROWS`` texts.

    The cluster names the shared folder in ``spark.checkpoint.dir``. Only where that is unset on one machine a temporary one is taken;
    elsewhere it is an error.
    """
    if int(spark.conf.get(BATCH)) > BATCH_ROWS or int(spark.conf.get(BATCH)) <= 0:
        spark.conf.set(BATCH, str(BATCH_ROWS))
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the shared folder as Parquet and read from there.

    A written table outlives executors and, unlike a checkpointed frame, carries no constraints of the plan it came
    from, which grow with every round of an iteration. It goes when the driver ends.
    """
    spark = ready(df.sparkSession)
    path = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/llm-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return what a task has freed to the machine; for the end of a Python function's batches.

    Spark keeps a worker for the tasks that follow, and its allocators keep all that a task ever held.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def packed(df: DataFrame, *columns: Column) -> DataFrame:
    """The whole row as the struct ``row`` beside the columns that an operator works on, so that no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *columns)


def unpacked(df: DataFrame, names: list[str], *new: tuple[str, Column]) -> DataFrame:
    """The packed row's columns and the new ones; a new column replaces one of the same name."""
    taken = {n.lower() for n, _ in new}
    # In two steps: an expression of a new column must not meet a row's column of the same name.
    made = df.select("row", F.struct(*[c.alias(n) for n, c in new]).alias("new"))
    return made.select(*[F.col("row").getField(c).alias(c) for c in names if c.lower() not in taken], *[F.col("new").getField(n).alias(n) for n, _ in new])


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Number of words; 0 for null. Counts the starts of words, so no array of words is built."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


# --- hashes in numpy -------------------------------------------------------------------------

_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15
_BYTE = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with good avalanche."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: One random number for each byte, from a rule.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self._up = self._down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            n = max(n, 2 * len(self._up), 4096)
            self._up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, self.base, np.uint64))])
            self._down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, self.inverse, np.uint64))])
        return self._up, self._down

    def keep(self, most: int = 1 << 22) -> None:
        """Drop tables that one very long text has grown."""
        if len(self._up) > most:
            self._up = self._down = np.ones(1, np.uint64)


BYTES, WORDS = Powers(_BYTE), Powers(0xA24BAED4963EE407)


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hash of each word of a UTF-8 text, all at once.

    A word's hash is a polynomial over its bytes' random values; the difference of two prefix sums
    gives it without a loop over words.
    """
    b = np.frombuffer(raw, np.uint8)
    blank = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.diff(np.concatenate([[True], blank, [True]]).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = BYTES.get(len(b) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[b] * up[: len(b)])])
    out = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    BYTES.keep()
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each run of ``n`` consecutive words; empty where there are fewer."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    up, down = WORDS.get(len(words) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])])
    out = mix((total[n:] - total[:-n]) * down[: len(words) - n + 1] + np.uint64(n))
    WORDS.keep()
    return out


# --- connected components -----------------------------------------------------------------------

def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 80) -> DataFrame:
    """``(node, label)`` for every node of ``edges``: the smallest node that can be reached.

    Each round hangs every node under the neighbour that comes first in an order drawn anew for the round, follows
    these links four deep, and contracts the edges. In a drawn order chains of links are short, whatever the shape, so that the
    nodes shrink by a constant factor a round. Only joins and aggregates: a hub with many links is never gathered.
    Empty edges give an empty result; loops and repeated edges do no harm. Edges with a null node are left out.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null")
    e = cut(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = e.select(F.col("a").alias("node")).union(e.select("b")).distinct().withColumn("label", F.col("node"))
    e = e.filter("a < b")
    for k in range(rounds):
        if e.isEmpty():
            smallest = labels.groupBy("label").agg(F.min("node").alias("least"))
            return labels.join(smallest, "label").select("node", F.col("least").alias("label"))
        place = lambda c: F.struct(F.xxhash64(F.lit(k), c).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        first = e.union(e.select("b", "a")).groupBy("a").agg(F.min(place("b")).alias("m"))
        up = cut(first.select(F.col("a").alias("n"), F.least(place("a"), F.col("m"))["n"].alias("up")))
        for _ in range(2):
            far = up.select(F.col("n").alias("up"), F.col("up").alias("far"))
            up = up.join(far, "up", "left").select("n", F.coalesce("far", "up").alias("up"))
        up = cut(up)
        labels = cut(labels.join(up, F.col("label") == F.col("n"), "left").select("node", F.coalesce("up", "label").alias("label")))
        ea = e.join(up.withColumnRenamed("up", "ua"), F.col("a") == F.col("n")).select("ua", "b")
        eb = ea.join(up.withColumnRenamed("up", "ub"), F.col("b") == F.col("n")).select("ua", "ub").filter("ua <> ub")
        e = cut(eb.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct())
    raise RuntimeError("components did not settle")
