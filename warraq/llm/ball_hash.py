"""Near copies by SimHash fingerprints, found by meet-in-the-middle ball hashing.

1. Each text gives one fingerprint of 64 bits: the majority of each bit over the hashes of its
   three-word shingles, repeats included.  Equal fingerprints are one class from there on (counted
   with partial sums), so a group of copies is one row.
2. Each class sends its fingerprint and all that differ in one bit, which is half the radius: 65
   variants.  Two fingerprints within two bits have a variant in common, midway between them.
   A variant is a key that at most 65 classes can have, so no key is hot whatever the texts are.
3. Classes that meet at a variant are pairs.  A pair meets at two variants; the smaller one keeps
   it, so pairs are distinct without another shuffle, and its bits are counted again there.
4. The components of the pairs are the result; documents get them by their fingerprint.

Defined results: a null text counts as empty; a text without words has fingerprint zero, which links
like any other; fewer than three words are one shingle.  Ties (a bit in exactly half of the hashes)
are 0.  Rows without id have a fingerprint, but link nothing: their component is null and they count
as nobody's link.  Rows that repeat an id count once for each distinct fingerprint of it.  An empty
table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq.llm.common import components, documents, joined_by_size, released, small_batches, text_of, written

#: Words of a shingle, seed of its hash, bits in which linked fingerprints differ at most, shingles that are counted at once.
WORDS, SEED, RADIUS, CHUNK = 3, 42, 2, 1 << 15
#: What stands between words, as bytes.
_WHITE = bytes(range(9, 14)) + b" "
_SPACES = bytes.maketrans(_WHITE, b" " * len(_WHITE))


def shingle_hashes(text: str) -> list[int]:
    """Hashes of the shingles of a text, in order, repeats included."""
    words = text.encode().lower().translate(_SPACES).split(b" ")
    words = [w for w in words if w]
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= WORDS:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: -WORDS] + 1).tolist()]
    hashed = xxhash.xxh64_intdigest
    return [hashed(line[a:b], SEED) for a, b in zip(starts, ends[WORDS - 1 :].tolist())]


def ones(hashes: list[int]) -> np.ndarray:
    """In how many of the hashes each bit is set, the lowest bit first."""
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = np.array(hashes[i : i + CHUNK], dtype="<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: str) -> int:
    """The majority of each bit, as an unsigned number."""
    hashes = shingle_hashes(text)
    bits = (2 * ones(hashes) > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _printed(batches):
    for batch in batches:
        prints = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "print"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row (doc_id, print) for each row of ``docs``; the print is a signed 64-bit number."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("body"))
    with small_batches(docs.sparkSession):
        return written(rows.mapInArrow(released(_printed), "doc_id long, print long"), "prints")


def variants(fingerprint_: Column) -> Column:
    """The fingerprint and all that differ from it in one bit."""
    flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << b) if b < 63 else -(1 << 63)).cast("long") for b in range(64)))
    return F.transform(flips, lambda flip: fingerprint_.bitwiseXOR(flip))


def near_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) with a < b of the distinct fingerprints ``print`` that differ in at most two bits."""
    met = classes.select("print", F.explode(variants(F.col("print"))).alias("variant"))
    met = met.groupBy("variant").agg(F.collect_list("print").alias("met")).where(F.size("met") > 1)  # 65 at most
    a, b = F.col("a"), F.col("b")
    pairs = met.select("variant", F.explode("met").alias("a"), "met").select("variant", "a", F.explode("met").alias("b")).where(a < b)
    both = a.bitwiseXOR(b)
    near = pairs.where(F.bit_count(both) <= RADIUS)
    # a pair meets at two places: what the one has from a it has from b at the other
    return near.where(F.col("variant") < F.col("variant").bitwiseXOR(both)).select("a", "b")


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, fingerprint, component_id, n_links."""
    prints = fingerprints(docs, doc_id, text)
    total = prints.count()
    known = prints.where("doc_id is not null").groupBy("doc_id", "print").agg(F.count("*").alias("times"))
    classes = written(known.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("members"), F.sum("times").alias("size")), "classes")
    pairs = written(near_pairs(classes), "pairs")
    member = lambda name: classes.select(F.col("print").alias(name), F.col("members").alias(f"{name}_members"))
    sized = pairs.join(member("a"), "a").join(member("b"), "b")
    links = sized.select("a", F.col("b_members").alias("k")).unionByName(sized.select(F.col("b").alias("a"), F.col("a_members").alias("k")))
    links = links.groupBy(F.col("a").alias("print")).agg(F.sum("k").alias("others"))
    joined = components(pairs).select(F.col("node").alias("print"), "component")
    with_links = classes.join(joined, "print", "left").join(links, "print", "left").withColumn("component", F.coalesce("component", "print"))
    with_links = written(with_links, "linked")
    least = with_links.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("classes"))
    placed = joined_by_size(with_links, written(least, "least"), ["component"], "classes", total)
    n_links = F.col("members") - 1 + F.coalesce("others", F.lit(0))
    placed = placed.select("print", "component_id", n_links.alias("n_links"), "size")
    out = joined_by_size(prints, written(placed, "placed"), ["print"], "size", total)
    has_id = F.col("doc_id").isNotNull()
    return out.select(
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.when(has_id, F.col("component_id")).alias("component_id"),
        F.when(has_id, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )


def op11_ball_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(documents(spark, sf_dir))


QUERIES = {"op11_ball_hash": op11_ball_hash}
