"""Lempel-Ziv phrase fingerprints.

A text is parsed into phrases (each the shortest that is not yet in its dictionary), the set of
phrases is hashed, and the minima of 64 hash functions are its fingerprint: the share of equal
minima estimates how much of two texts' dictionaries is common, as a compressor of both would.

The next document of each is found without a global window: ids are dealt into ranges by
quantiles, the first document of each range is also sent to the range before, and each range is
one sorted stream that holds a single earlier row.

Defined results: a null text counts as empty; an empty text has fingerprint '' and likeness 1 to
an empty one, 0 to others; rows of equal id follow each other by text hash; rows without id come
first; a single document is its own next; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq.llm.common import documents, partitions, text_of
from warraq.llm.hashing import signature, signature_seeds, span_hashes

#: Hash functions of a fingerprint, 16 bits each.
FUNCTIONS = 64
SEEDS = signature_seeds(FUNCTIONS)


class Parse:
    """A parse that can stop at any character and go on from there more than once."""

    def __init__(self, seen=(), open_phrase="", cuts=(), at=0):
        self.seen, self.open, self.cuts, self.at = set(seen), open_phrase, list(cuts), at

    def copy(self) -> Parse:
        return Parse(self.seen, self.open, self.cuts, self.at)

    def feed(self, text: str) -> Parse:
        seen, phrase, cut = self.seen, self.open, self.cuts.append
        for at, letter in enumerate(text, self.at + 1):
            phrase += letter
            if phrase not in seen:
                seen.add(phrase)
                cut(at)
                phrase = ""
        self.open, self.at = phrase, self.at + len(text)
        return self


def fingerprint(text: str, cuts: list[int]) -> np.ndarray | None:
    if not cuts:
        return None
    ends = np.array(cuts)
    starts = np.concatenate([[0], ends[:-1]])
    return signature(span_hashes(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), starts, ends), SEEDS)


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is None and b is None)
    return float(np.count_nonzero(a == b)) / FUNCTIONS


def as_text(print_: np.ndarray | None) -> str:
    return "" if print_ is None else print_.astype(">u2").tobytes().hex()


def _parsed(text: str):
    """The fingerprint, and the parse as it stood where the last quarter begins."""
    parse = Parse().feed(text[: len(text) - len(text) // 4])
    at_edit = parse.copy()
    return fingerprint(text, parse.feed(text[len(text) - len(text) // 4 :]).cuts), at_edit


def _stream(batches):
    """Rows (cell, doc_id, text, ghost) in order: each but a ghost, with the next of its cell."""
    held = None
    for batch in batches:
        out = []
        for cell, doc_id, text, ghost in zip(*(batch.column(i).to_pylist() for i in range(4))):
            print_, at_edit = _parsed(text)
            if held is not None and held[0] == cell:
                _, of, body, own, parse = held
                quarter = len(body) // 4
                edited = body[: len(body) - quarter] + text[:quarter]
                other = fingerprint(edited, parse.feed(text[:quarter]).cuts)
                out.append((of, len(body), hashlib.sha256(edited.encode()).hexdigest(), as_text(own), as_text(other), likeness(own, other), likeness(own, print_)))
            held = None if ghost else (cell, doc_id, text, print_, at_edit)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def placed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """Rows (cell, doc_id, body, h) whose cells follow each other in the order of id and text hash, and
    the number of cells.  Rows with ids are dealt by quantiles of the ids; rows without come before
    them and are dealt by ranges of the hash, into cells of about the same size."""
    many = partitions(docs.sparkSession)
    body = text_of(text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("body"), F.xxhash64(body).alias("h"))
    total, known = docs.agg(F.count("*"), F.count(doc_id)).first()
    nameless = -(-(total - known) * many // total) if total > known else 0
    place = F.col("doc_id").cast("double")
    steps = [i / many for i in range(1, many)]
    ids = rows.where("doc_id is not null").select(place.alias("place"))
    inner = sorted(set(ids.approxQuantile("place", steps, 0.1 / many))) if many > 1 and known else []
    dealt = Bucketizer(splits=[float("-inf"), *(inner or [0.0]), float("inf")], inputCol="place", outputCol="bucket")
    rows = dealt.transform(rows.withColumn("place", F.coalesce(place, F.lit(float("-inf")))))
    by_hash = F.floor((F.col("h") / float(1 << 64) + 0.5) * nameless)
    cell = F.when(F.col("doc_id").isNull(), F.least(by_hash, F.lit(max(0, nameless - 1)))).otherwise(F.col("bucket") + nameless)
    return rows.select(cell.cast("int").alias("cell"), "doc_id", "body", "h"), nameless + len(inner) + 2


def phrase_prints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs`` with its fingerprint, that of its edited text, and likenesses."""
    spark = docs.sparkSession
    rows, cells = placed_rows(docs, doc_id, text)
    # one row a cell: its first document, which the cell before needs too
    firsts = rows.groupBy("cell").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h")).alias("first")).select("cell", "first").collect()
    firsts = sorted((r[0], r[1]) for r in firsts)
    before = [(first.doc_id, first.h, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    ghosts = spark.createDataFrame(before, "_id long, _h long, _cell int")
    ghosts = (
        rows.join(F.broadcast(ghosts), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))
        .dropDuplicates(["_cell"])
        .select(F.col("_cell").alias("cell"), "doc_id", "body", "h", F.lit(True).alias("ghost"))
    )
    every = rows.withColumn("ghost", F.lit(False)).unionByName(ghosts)
    return (
        every.repartitionById(cells, F.col("cell"))
        .sortWithinPartitions("cell", "ghost", F.asc_nulls_first("doc_id"), "h")
        .select("cell", "doc_id", "body", "ghost")
        .mapInArrow(_stream, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    )


def op3_phrase_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_prints(documents(spark, sf_dir))


QUERIES = {"op3_phrase_print": op3_phrase_print}
