"""What several operators share: tables in the shared folder, texts, and bounded filters."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a filter for each of its keys, and of a row of its bitmap (a fixed value of Spark's bitmap functions).
KEY_BITS, ROW_BITS = 16, 15
#: Bits of a filter at most: 16 MB, which any executor can take as a broadcast.
MOST_BITS = 27
#: Texts of an Arrow batch.
ARROW_ROWS = 1000
#: Edges of a graph that a task looks at together, at most (16 bytes each).
EDGES = 1_000_000
#: Short rows of numbers that are broadcast, at most (some MB).
FEW = 100_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Where the session names none, as in tests, a folder of this machine is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="spark-warraq-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends there, and a
    lost executor costs a read, not the work before it.  With a ``path``, what stood there goes."""
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/warraq/{what}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ARROW_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = ARROW_ROWS):
    """At most ``rows`` texts in an Arrow batch of the jobs that run within: a batch of whole texts is
    some MB then, in the worker as in the buffers of the executor.  The session's own bound comes back."""
    own = spark.conf.get(ARROW_KEY)
    spark.conf.set(ARROW_KEY, str(min(int(own), rows) if int(own) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_KEY, own)


def give_back() -> None:
    """Freed memory goes back to the system: a worker waits for later tasks with what it holds."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another system's library
        pass


def released(run):
    """``run`` over a task's batches, with its memory given back at the end."""

    def through(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return through


def text_of(column: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def filter_bits(keys: int, most: int = MOST_BITS) -> int | None:
    """Bits (as a power of two) of a filter over so many keys: KEY_BITS for each, so that about one in
    KEY_BITS other rows gets through at any number of keys; None where that is more than may be
    broadcast."""
    bits = max(ROW_BITS, (keys * KEY_BITS - 1).bit_length()) if keys else ROW_BITS
    return bits if bits <= most else None


def marked(rows: DataFrame, key: Column, keys: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """``rows`` with ``_may``: true for all rows whose 64-bit ``key`` is among those of ``keys`` (one
    column), and for few others.

    The filter is a bitmap that is sized by the number of keys, broadcast in rows of 4 KB.  Beyond
    ``most`` bits there is none and ``_may`` is true for every row: the exact step after it then
    takes all of them by shuffle, which costs one exchange of the rows and nothing else."""
    name = keys.columns[0]
    bits = filter_bits(keys.count(), most)
    if bits is None:
        return rows.withColumn("_may", F.lit(True))
    place = lambda c: F.pmod(c, F.lit(1 << bits))
    maps = keys.groupBy(F.shiftright(place(F.col(name)), ROW_BITS).alias("_row")).agg(
        F.bitmap_construct_agg(F.pmod(F.col(name), F.lit(1 << ROW_BITS))).alias("_map")
    )
    maps = written(maps, "filter")
    low = F.pmod(F.col("_key"), F.lit(1 << ROW_BITS))
    unit = F.conv(F.hex(F.substring(F.col("_map"), (F.shiftright(low, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(unit, F.pmod(low, F.lit(8)).cast("int")) == 1, F.lit(False))
    joined = rows.withColumn("_key", key).join(F.broadcast(maps), F.shiftright(place(F.col("_key")), ROW_BITS) == F.col("_row"), "left")
    return joined.withColumn("_may", hit).drop("_key", "_row", "_map")


def thinned(rows: DataFrame, key: Column, keys: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Rows whose 64-bit ``key`` may be among ``keys``: all that are, and few others.  Whatever is
    right after it must be exact."""
    return marked(rows, key, keys, most).where("_may").drop("_may")


def without(rows: DataFrame, key: Column, gone: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """``rows`` whose key (null-safe) is not among those of ``gone`` (one column, distinct or not).

    A filter over the keys that go tells most rows apart where they lie; only those that it can't
    clear are shuffled to the exact anti-join."""
    name = gone.columns[0]
    flags = marked(rows.withColumn("_own", key), F.xxhash64("_own"), gone.select(F.xxhash64(name)), most)
    doubtful = flags.where("_may").join(gone.select(F.col(name).alias("_gone")), F.col("_own").eqNullSafe(F.col("_gone")), "left_anti")
    return flags.where("not _may").unionByName(doubtful).drop("_own", "_may")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """``df`` (a written table), to be broadcast where it has no more than ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def joined_by_size(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, least: int = 1000) -> DataFrame:
    """``rows`` left-joined with ``groups`` (one row a key, with the number of rows it has as ``size``).

    Groups with over a thousandth of all rows (and over ``least`` rows) are at most 1000 and go by
    broadcast, so that the shuffle join that takes the rest has no large group."""
    hot = F.col(size) > max(least, total // 1000)
    large = groups.where(hot).select(*keys, F.struct(*(c for c in groups.columns if c not in keys)).alias("_large"))
    held = rows.join(F.broadcast(large), keys, "left")
    rest = [c for c in groups.columns if c not in keys]
    found = held.where("_large is not null").select(*rows.columns, *(F.col(f"_large.{c}").alias(c) for c in rest))
    return found.unionByName(held.where("_large is null").drop("_large").join(groups.where(~hot), keys, "left").select(*rows.columns, *rest))


def joined_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least number that each of n can reach over the edges."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label = up
    return label


def _forest(batches, most):
    """Edges (a, b) as a star round the least node of each piece; about ``most`` are looked at together, so
    that a task's memory is bounded, and what is then left of them goes on with the next ones."""

    def stars(held):
        a, b = (np.concatenate(x) for x in zip(*held))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = joined_labels(at[: len(a)], at[len(a) :], len(nodes))
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        return nodes[moved], nodes[label[moved]]

    held, n = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n > most:
            held = [stars(held)]
            n = len(held[0][0])
            if n > most // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["a", "b"])
                held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(held)], names=["a", "b"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (node, component) for the nodes of ``edges`` (a written table; a, b, both long): the smallest
    node that each can reach.

    Tasks of about EDGES each first turn what they have into stars, without a shuffle.  That settles a
    graph of no more than EDGES edges; of a larger one, what is left goes through alternating large-star and small-star rounds: each sends a node's larger (then
    smaller) neighbours to the smallest one, so hubs thin out and the rounds grow with the logarithm of
    the longest path.  Minima are partial sums before their shuffle; a hub's own edges (16 bytes each) are
    split by the adaptive skew join.  Edges stay in Spark: a round's are a written table, which takes
    the place of those two rounds before."""
    spark = edges.sparkSession
    paths = [f"{shared_folder(spark)}/warraq/edges-{uuid.uuid4().hex}" for _ in range(2)]
    forest = lambda df: df.mapInArrow(released(lambda batches, most=EDGES: _forest(batches, most)), "a long, b long")
    n = edges.count()
    e = written(forest(edges.where("a <> b").select("a", "b").coalesce(max(1, -(-n // EDGES)))), "edges", paths[0])
    state = None
    for k in range(rounds if n > EDGES else 0):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        e = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        ends = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        e = e.join(least, "a").select(ends.alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        e = written(e, "edges", paths[(k + 1) % 2])
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == state:
            break
        state = now
    else:
        if n > EDGES:
            raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
