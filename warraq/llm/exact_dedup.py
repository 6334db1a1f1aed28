"""Exact duplicates by a Golomb-coded fingerprint exchange.

Senders sort the short fingerprints of their rows, code the gaps (Golomb-Rice) and send one code
for each owner of a hash range; owners answer with one bit a fingerprint: seen by another sender
or not.  The bits meet the sender's own codes again, never raw fingerprints, and only suspects
(marked there, or repeated at the sender itself) have their texts shuffled, where equal bytes meet.
A sender sends a repeated fingerprint once, and texts are pre-aggregated before the shuffle, so a
group with a third of all rows is a few rows for each task.

Defined results: a null text counts as empty; rows without id keep a null ``keep_id`` unless a
copy has an id; of rows equal in both text and id exactly one is kept; an empty table gives an
empty result; further columns of the input are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq.llm.common import documents, joined_by_size, marked, text_of, thinned, without, written

#: Distinct fingerprints of an owner, about: the number of owners follows the rows.
OWNER_ROWS = 50_000
#: Rows that a sender codes at a time.
SEND_ROWS = 200_000


def golomb_code(values: np.ndarray, k: int) -> bytes:
    """Sorted distinct non-negative integers as gaps: quotients (gap >> k) in unary, then the low k bits."""
    gaps = np.diff(values, prepend=0)
    high = gaps >> k
    ends = np.cumsum(high + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, dtype=np.uint8)
    unary[ends] = 1
    low = ((gaps[:, None] >> np.arange(k)) & 1).astype(np.uint8)
    return np.packbits(np.concatenate([unary, low.ravel()])).tobytes()


def golomb_decode(code: bytes, n: int, k: int) -> np.ndarray:
    """What ``golomb_code`` was given."""
    bits = np.unpackbits(np.frombuffer(code, dtype=np.uint8))
    ends = np.flatnonzero(bits)[:n] if n else np.empty(0, dtype=np.int64)
    high = np.diff(ends, prepend=-1) - 1
    start = int(ends[-1]) + 1 if n else 0
    low = bits[start : start + n * k].reshape(n, k).astype(np.int64) @ (1 << np.arange(k, dtype=np.int64))
    return np.cumsum((high.astype(np.int64) << k) + low)


def rice_parameter(n: int, span_bits: int) -> int:
    return max(0, span_bits - max(1, n).bit_length())


SENT = pa.schema([("sender", pa.string()), ("owner", pa.int32()), ("n", pa.int64()), ("code", pa.binary()), ("repeated", pa.binary())])
ANSWER = pa.schema([("sender", pa.string()), ("owner", pa.int32()), ("marks", pa.binary())])
ddl = lambda schema: ", ".join(f"{f.name} { {'int32': 'int', 'int64': 'long'}.get(str(f.type), f.type)}" for f in schema)


def print_bits(n: int) -> tuple[int, int]:
    """Bits of a fingerprint, and of them those below its owner's.  Of n rows fewer than one in
    2**15 is a suspect by chance."""
    bits = min(62, max(32, n.bit_length() + 16))
    return bits, bits - max(4, (n // OWNER_ROWS).bit_length())


def _send(batches, span):
    """Sorted, coded fingerprints of each block of rows, an owner a row."""

    def coded(prints: np.ndarray):
        distinct, counts = np.unique(prints, return_counts=True)
        owners, sender, rows = distinct >> span, uuid.uuid4().hex, []
        for owner in np.unique(owners):
            at = slice(*np.searchsorted(owners, [owner, owner + 1]))
            own = distinct[at] - (owner << span)
            code = golomb_code(own, rice_parameter(len(own), span))
            rows.append((sender, int(owner), len(own), code, np.packbits(counts[at] > 1).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SENT.types)], schema=SENT)

    held, n = [], 0
    for batch in batches:
        held.append(batch.column(0).to_numpy(zero_copy_only=False))
        n += len(held[-1])
        if n >= SEND_ROWS:
            yield coded(np.concatenate(held))
            held, n = [], 0
    if n:
        yield coded(np.concatenate(held))


def _own(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's answer to each sender: a bit for each fingerprint that another sender has too.

    A sender has sent each once, so an owner holds about OWNER_ROWS of them."""
    sent = [r for b in batches for r in zip(*(b.column(x).to_pylist() for x in ("sender", "n", "code", "span")))]
    lists = [golomb_decode(code, n, rice_parameter(n, span)) for _, n, code, span in sent]
    every = np.sort(np.concatenate(lists))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    marks = [np.packbits(np.isin(x, twice, assume_unique=True)).tobytes() for x in lists]
    yield pa.RecordBatch.from_pydict({"sender": [r[0] for r in sent], "owner": [key[0].as_py()] * len(sent), "marks": marks}, schema=ANSWER)


def _suspects(batches, span):
    """The fingerprints that a sender or an owner has marked, from the sender's own code."""
    for batch in batches:
        for row in zip(*(batch.column(x).to_pylist() for x in ("owner", "n", "code", "repeated", "marks"))):
            owner, n, code, *bits = row
            repeated, marks = (np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x in bits)
            prints = golomb_decode(code, n, rice_parameter(n, span)) + (owner << span)
            yield pa.RecordBatch.from_arrays([pa.array(prints[(repeated | marks).astype(bool)], pa.int64())], names=["print"])


def suspect_prints(prints: DataFrame, span: int) -> DataFrame:
    """The fingerprints (one column, long) that occur more than once, written."""
    sent = written(prints.mapInArrow(lambda batches: _send(batches, span), ddl(SENT)), "sent")
    asked = sent.select("sender", "owner", "n", "code", F.lit(span).alias("span"))
    answers = asked.groupBy("owner").applyInArrow(_own, ddl(ANSWER))
    found = sent.join(answers, ["sender", "owner"]).select("owner", "n", "code", "repeated", "marks")
    return written(found.mapInArrow(lambda batches: _suspects(batches, span), "print long"), "suspects")


def identical_rows(keepers: DataFrame) -> DataFrame:
    """Of the rows (doc_id, text_sha256) of groups' keepers those that occur more than once, with the
    number that they do; an aggregation with partial counts, which finds hardly any."""
    return written(keepers.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("times")).where("times > 1"), "identical")


def copies_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """A row for each row of ``docs`` (doc_id, keep_id, group_size, text_sha256), and the identical rows among keepers."""
    body = text_of(text)
    total = docs.count()
    bits, span = print_bits(total)
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body"), F.shiftrightunsigned(F.xxhash64(body), 64 - bits).alias("print"))
    suspects = suspect_prints(rows.select("print"), span)

    digest = F.sha2(F.col("body").cast("binary"), 256)
    groups = (
        thinned(rows, F.col("print"), suspects)
        .groupBy("body")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
        .select(digest.alias("text_sha256"), F.struct("keep_id", "group_size").alias("grp"), "group_size")
    )
    groups = written(groups, "groups")
    ids = rows.select("doc_id", digest.alias("text_sha256"))
    out = joined_by_size(ids, groups, ["text_sha256"], "group_size", total).select(
        "doc_id",
        F.when(F.col("grp").isNull(), F.col("doc_id")).otherwise(F.col("grp.keep_id")).alias("keep_id"),
        F.coalesce("grp.group_size", F.lit(1)).cast("long").alias("group_size"),
        "text_sha256",
    )
    return out, identical_rows(out.where(keeper() & (F.col("group_size") > 1)).select("doc_id", "text_sha256"))


def keeper() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("keep_id"))


def pair() -> Column:
    return F.xxhash64("doc_id", "text_sha256")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    out, again = copies_of(docs, doc_id, text)
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    if again.isEmpty():
        return out.withColumn("kept", keeper()).select(columns)
    # rows equal in id and text get places, which are written down once; the least of each stays
    flags = marked(out, pair(), again.select(pair()))
    placed = written(flags.where("_may").withColumn("place", F.monotonically_increasing_id()), "placed")
    first = placed.groupBy("doc_id", "text_sha256").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    chosen = placed.join(first, "place", "left").withColumn("kept", keeper() & F.col("first").isNotNull())
    return flags.where("not _may").withColumn("kept", keeper()).select(columns).unionByName(chosen.select(columns))


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one with the largest id; all columns stay."""
    out, again = copies_of(docs)
    key = lambda sha: F.struct("doc_id", sha.alias("sha"))
    gone = written(out.where(~keeper()).select(key(F.col("text_sha256")).alias("gone")), "gone")
    rows = docs.select(F.struct("*").alias("row"), key(F.sha2(text_of().cast("binary"), 256)).alias("key"))
    kept = without(rows, F.col("key"), gone)
    if not again.isEmpty():
        flags = marked(kept, F.expr("xxhash64(key.doc_id, key.sha)"), again.select(pair()))
        once = flags.where("_may").dropDuplicates(["key"])  # partial: a task sends one of each
        kept = flags.where("not _may").unionByName(once)
    return kept.select("row.*")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


QUERIES = {"op9_exact_dedup": op9_exact_dedup}
ORACLES = {
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
}
