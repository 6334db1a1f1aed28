"""Language-model scores by prediction by partial matching over bytes.

The model is all byte contexts up to ORDER, pretrained on the documents that are not held out: no
context and no symbol is left out, so the model grows with the corpus and stays in Spark.  Texts are
dealt into blocks of about BLOCK bytes.  A block asks once for each of its distinct (ORDER + 1)-grams
and says how often its training texts have them; the requests go to the owner of the gram's last
three context bytes, who so holds all contexts of orders 3 to ORDER that end in them, adds the counts
up and answers each block with its grams' logarithms, from which the block sums its texts' scores.
The number of owners grows with the bytes of the training texts.  Where the blocks ask one owner for
more than TASK_GRAMS grams (a context that all texts have), its requests are dealt into parts: parts
add their counts up, these sums are added up FAN at a time, and each part is answered from the whole.
Contexts of orders 0 to 2 have at most 2^24 symbols whatever the corpus, and are broadcast.

The probability of a byte is found from its longest context in the model: the symbol's count, or an
escape (half a count from each distinct symbol) to the next shorter context, from which all symbols
of the longer one are excluded; in the end all bytes left are equally likely.  0xFF, which no text
contains, is the end of a text and stands before its start.  A text is scored as its lower-cased
words with single spaces between and the end, so that the score is a probability of the same event
as the base score.  Logarithms travel as 32-bit floats.

The base score needs the count of every word: words with over 1 / HEAD of all tokens are few and
go by broadcast, the others are joined by shuffle, summed for each document first.

Defined results: a null text counts as empty and is the end token alone; rows without id count as
id ''; repeated rows count as often as they occur; without training texts all bytes are equally
likely; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq.llm.common import documents, partitions, released, remainder, text_of, written

#: Bytes of the longest context.
ORDER = 5
#: Bits of an order-3 context, and at least of the number of the buckets that these are dealt into; an odd factor and its inverse.
NEAR, BUCKET = 24, 10
MIX = 0x9E3779
BACK = pow(MIX, -1, 1 << NEAR)
#: Bytes of texts of a block.
BLOCK = 1 << 24
#: Bytes of training texts for each bucket, at most, until there is one for each context of order 3.
BUCKET_BYTES = 1 << 25
#: Grams asked of one task, about, and sums of parts that are added up at a time.
TASK_GRAMS, FAN = 1 << 23, 16
#: Words with over 1 / HEAD of all tokens are broadcast: fewer than HEAD.
HEAD = 1 << 17
#: Bytes that are turned into grams at once, and distinct grams or words that a task holds.
CHUNK, HELD = 1 << 22, 1_000_000
END = 0xFF


def tokens_of(text: str) -> list[bytes]:
    return text.encode().lower().split()  # bytes: A-Z only, and split at \x20\x09-\x0D


def segments(words: list[bytes], order: int = ORDER):
    """The bytes of a text's event with ``order`` bytes of context before each piece."""
    whole = bytes([END]) * order + b" ".join(words) + bytes([END])
    for at in range(0, len(whole) - order, CHUNK):
        yield whole[at : at + CHUNK + order]


def grams_of(pieces: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The code of each position of the pieces (context and byte), and how many each piece has."""
    units = np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.int64)
    codes = units[: len(units) - order].copy()
    for i in range(1, order + 1):
        codes <<= 8
        codes |= units[i : len(units) - order + i]
    sizes = np.array([len(p) for p in pieces])
    last = np.cumsum(sizes)
    own = np.ones(len(codes), dtype=bool)
    for i in range(order):  # positions that would run from one piece into the next
        at = last[:-1] - order + i
        own[at] = False
    return codes[own], sizes - order


def dealt(codes: np.ndarray) -> np.ndarray:
    """Codes with the (mixed) order-3 context first, so that a bucket is a range: bijective."""
    near = (codes >> 8) & ((1 << NEAR) - 1)
    return ((near * MIX) & ((1 << NEAR) - 1)) << 24 | (codes >> 32) << 8 | (codes & 0xFF)


def code_of(keys: np.ndarray) -> np.ndarray:
    near = ((keys >> 24) * BACK) & ((1 << NEAR) - 1)
    return ((keys >> 8) & 0xFFFF) << 32 | near << 8 | (keys & 0xFF)


def bucket_bits(size: int) -> int:
    """Bits of the number of buckets for so many bytes of training texts."""
    return min(NEAR, max(BUCKET, (size // BUCKET_BYTES).bit_length()))


def packed(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value, byte by byte, compressed."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize)[:, :width].T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, size: int, width: int, dtype=np.int64) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=size * width, codec="zstd", asbytes=True), np.uint8)
    out = np.zeros((size, np.dtype(dtype).itemsize), np.uint8)
    out[:, :width] = planes.reshape(width, size).T
    return out.view(dtype).ravel()


def coded(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys as gaps, and their counts."""
    return packed(np.diff(keys, prepend=0), 6), packed(counts, 8)


def keys_of(data: bytes, size: int) -> np.ndarray:
    return np.cumsum(unpacked(data, size, 6))


def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*held))
    distinct, of = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(of, counts, len(distinct)).astype(np.int64)


def chunked(events: list[bytes]):
    """Of about CHUNK bytes at a time: the pieces, and the text that each is of."""
    pieces, owners, size = [], [], 0
    for i, event in enumerate(events):
        for piece in segments([event]):
            pieces.append(piece)
            owners.append(i)
            size += len(piece)
            if size >= CHUNK:
                yield pieces, np.array(owners)
                pieces, owners, size = [], [], 0
    if pieces:
        yield pieces, np.array(owners)


REQUEST = "block long, bucket int, size long, keys binary, counts binary, rid array<long>, doc_id array<long>, held_out array<boolean>, texts binary"
#: Buckets of the rows that hold a block's texts, and its counts of order 2.
TEXTS, LOW = -1, -2


def _requests(batches, bits):
    import pandas as pd

    types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary()]

    def block(rids, ids, out, events):
        train, held = ~np.array(out, dtype=bool), []
        for pieces, owners in chunked(events):
            codes, sizes = grams_of(pieces)
            of, distinct = pd.factorize(codes)
            held.append((dealt(distinct), np.bincount(of, np.repeat(train[owners], sizes), len(distinct))))
            if sum(len(k) for k, _ in held) >= 4 * HELD:
                held = [merged(held)]
        keys, counts = merged(held)
        low, low_n = merged([(code_of(keys) & ((1 << NEAR) - 1), counts)])
        low, low_n = low[low_n > 0], low_n[low_n > 0]
        whole = b"\xff".join(events)
        rows = [(rids[0], TEXTS, len(whole), None, None, rids, ids, out, pa.compress(whole, codec="zstd", asbytes=True)), (rids[0], LOW, len(low), packed(low, 3), packed(low_n, 8)) + (None,) * 4]
        buckets = keys >> (48 - bits)
        starts = np.flatnonzero(np.diff(buckets, prepend=-1))
        for i, a, b in zip(buckets[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)]):
            rows.append((rids[0], i, b - a, *coded(keys[a:b], counts[a:b])) + (None,) * 4)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=[c.split()[0] for c in REQUEST.split(", ")])

    held, size = ([], [], [], []), 0
    for batch in batches:
        for rid, doc_id, out, text in zip(*(c.to_pylist() for c in batch.columns)):
            event = b" ".join(tokens_of(text))
            for column, value in zip(held, (rid, doc_id, out, event)):
                column.append(value)
            size += len(event) + 1
            if size >= BLOCK:
                yield block(*held)
                held, size = ([], [], [], []), 0
    if held[0]:
        yield block(*held)


def _low_counts(batches):
    for batch in batches:
        for size, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
            yield pa.RecordBatch.from_arrays([pa.array(unpacked(keys, size, 3)), pa.array(unpacked(counts, size, 8))], names=["code", "n"])


def _counted_words(batches):
    tally = Counter()

    def row():
        return pa.RecordBatch.from_arrays([pa.array(list(tally.keys()), pa.binary()), pa.array(list(tally.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            tally.update(tokens_of(text))
            if len(tally) >= HELD // 2:
                yield row()
                tally.clear()
    if tally:
        yield row()


class Trie:
    """Contexts by order, as sorted arrays, with what an escape and an exclusion need."""

    def __init__(self, orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], below: Trie | None = None):
        """orders[j]: codes and counts of the symbols, codes and totals of the contexts, of order j, after those of ``below``."""
        self.orders = list(below.orders) if below else []
        for j, (code, n, context, total) in enumerate(orders, len(self.orders)):
            by, at = np.argsort(code), np.argsort(context)
            code, n, context, total = code[by], n[by].astype(float), context[at], total[at].astype(float)
            of = np.searchsorted(context, code >> 8)
            distinct = np.bincount(of, minlength=len(context)).astype(float)
            left_out = total - np.bincount(of, n, len(context))
            excluded = np.zeros(len(context))
            if j and len(code):  # mass of a context's symbols in the context one shorter
                below_code, below_n = self.orders[-1][:2]
                shorter = code & ((1 << 8 * j) - 1)
                excluded = np.bincount(of, below_n[np.searchsorted(below_code, shorter)], len(context))
            self.orders.append((code, n, context, total, distinct, left_out, excluded))

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 of the probability of each code's byte after its context."""
        out = np.zeros(len(codes))
        gone, fewer = np.zeros(len(codes)), np.zeros(len(codes))
        todo = np.arange(len(codes))
        for j in range(len(self.orders) - 1, -1, -1):
            code, n, context, total, distinct, left_out, excluded = self.orders[j]
            if not len(context):
                continue
            mine = codes[todo] & ((1 << 8 * (j + 1)) - 1)
            at = np.minimum(np.searchsorted(context, mine >> 8), len(context) - 1)
            known = context[at] == mine >> 8
            here, at, mine = todo[known], at[known], mine[known]
            mass = total[at] - gone[here]
            place = np.minimum(np.searchsorted(code, mine), len(code) - 1)
            hit = code[place] == mine
            out[here[hit]] += np.log10((n[place[hit]] - 0.5) / mass[hit])
            miss = ~hit & (mass > 0)
            out[here[miss]] += np.log10(((distinct[at] - fewer[here]) / 2 + left_out[at])[miss] / mass[miss])
            gone[here], fewer[here] = excluded[at], distinct[at]
            done = np.zeros(len(todo), dtype=bool)
            done[np.flatnonzero(known)[hit]] = True
            todo = todo[~done]
        lowest = float(len(self.orders[0][0])) if self.orders else 0.0
        out[todo] -= np.log10(max(1.0, 256.0 - lowest))
        return out


def levels(codes: np.ndarray, counts: np.ndarray, orders: range) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """What Trie takes for the orders, from the codes of the longest (or a longer) one."""
    out = []
    for j in reversed(orders):
        codes, counts = merged([(codes & ((1 << 8 * (j + 1)) - 1), counts)])
        out.append((codes, counts, *merged([(codes >> 8, counts)])))
    return out[::-1]


def summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of coded rows, with the sums of their counts."""
    held = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for size, keys, counts in zip(table.column("size").to_pylist(), table.column("keys"), table.column("counts")):
        held.append((keys_of(keys.as_py(), size), unpacked(counts.as_py(), size, 8)))
        if sum(len(k) for k, _ in held) >= 4 * HELD:
            held = [merged(held)]
    return merged(held)


SUM, ANSWER = "bucket int, part int, size long, keys binary, counts binary", "block long, bucket int, size long, keys binary, logs binary"


def _sums(table: pa.Table) -> pa.Table:
    """One row with the counts of all rows of a part; none where no training text has a gram of it."""
    keys, counts = summed(table)
    keys, counts = keys[counts > 0], counts[counts > 0]
    columns = {"bucket": pa.int32(), "part": pa.int32(), "size": pa.int64(), "keys": pa.binary(), "counts": pa.binary()}
    rows = [(table.column("bucket")[0].as_py(), table.column("part")[0].as_py(), len(keys), *coded(keys, counts))] if len(keys) else []
    return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(columns.items())})


def answered(requests: pa.Table, asked: np.ndarray, known: np.ndarray, counts: np.ndarray, below: Trie) -> pa.Table:
    """Each request's grams with their logarithms.  asked: distinct keys; known, counts: those of the bucket that training texts have."""
    logs = Trie(levels(code_of(known), counts, range(3, ORDER + 1)), below).log10(code_of(asked)).astype(np.float32)
    own = [packed(logs[np.searchsorted(asked, keys_of(keys.as_py(), size))], 4) for size, keys in zip(requests.column("size").to_pylist(), requests.column("keys"))]
    return requests.select(["block", "bucket", "size", "keys"]).append_column("logs", pa.array(own, pa.binary()))


def answers_to(asked: DataFrame, below) -> DataFrame:
    """Rows ANSWER for the requests.  below: the broadcast trie of the orders that all buckets share."""
    spark = asked.sparkSession

    def alone(requests: pa.Table) -> pa.Table:
        keys, counts = summed(requests)
        return answered(requests, keys, keys[counts > 0], counts[counts > 0], below.value)

    def of_part(requests: pa.Table, whole: pa.Table) -> pa.Table:
        return answered(requests, summed(requests)[0], *summed(whole), below.value)

    loads = written(asked.groupBy("bucket").agg(F.ceil(F.sum("size") / TASK_GRAMS).cast("int").alias("parts")), "loads")
    width = loads.agg(F.coalesce(F.max("parts"), F.lit(1))).first()[0]
    usual = asked.join(loads.where("parts = 1"), "bucket", "left_semi") if width > 1 else asked
    answers = usual.repartition(partitions(spark), "bucket").groupBy("bucket").applyInArrow(alone, ANSWER)
    if width == 1:
        return answers
    many = asked.join(loads.where("parts > 1"), "bucket").withColumn("part", F.pmod(F.xxhash64("block"), F.col("parts")).cast("int"))
    sums = many
    while True:
        sums = written(sums.select("bucket", "part", "size", "keys", "counts").groupBy("bucket", "part").applyInArrow(_sums, SUM), "sums")
        if width == 1:
            break
        width = -(-width // FAN)
        sums = sums.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
    parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    sums = sums.drop("part").join(loads, "bucket").select("bucket", parts.alias("part"), "size", "keys", "counts")
    return answers.unionByName(many.drop("parts").groupBy("bucket", "part").cogroup(sums.groupBy("bucket", "part")).applyInArrow(of_part, ANSWER))


def corpus_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), (remainder(doc_id, 5) == 1).alias("held_out"), text_of(text).alias("body"))
    train = rows.where(~F.col("held_out"))
    ends = train.count()
    words = written(train.select("body").mapInArrow(_counted_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")), "words")
    size = F.sum(F.col("c") * (F.octet_length("word") + 1))
    distinct, tokens, size = words.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(size, F.lit(0))).first()
    bits = bucket_bits(size)
    tokens, distinct = tokens + ends, distinct + (ends > 0)
    head = words.where(F.col("c") > tokens / HEAD).toPandas()
    known = spark.sparkContext.broadcast(dict(zip(map(bytes, head["word"]), head["c"].tolist())))
    blocks = written(rows.mapInArrow(released(lambda batches: _requests(batches, bits)), REQUEST), "blocks")
    low = blocks.where(F.col("bucket") == LOW).select("size", "keys", "counts").mapInArrow(_low_counts, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    below = spark.sparkContext.broadcast(Trie(levels(low["code"].to_numpy(np.int64), low["n"].to_numpy(np.int64), range(3))))
    answers = answers_to(blocks.where("bucket >= 0").select("block", "bucket", "size", "keys", "counts"), below)
    level = float(np.log10(tokens + 0.5 * (distinct + 1)))
    end_log = float(np.log10(ends + 0.5))

    def scored(texts: pa.Table, answers: pa.Table) -> pa.Table:
        import pandas as pd

        heads = {w: float(np.log10(c + 0.5)) for w, c in known.value.items()}
        parts = sorted(zip(answers.column("bucket").to_pylist(), answers.column("size").to_pylist(), answers.column("keys").to_pylist(), answers.column("logs").to_pylist()))
        keys = np.concatenate([keys_of(k, size) for _, size, k, _ in parts])
        logs = np.concatenate([unpacked(x, size, 4, np.float32) for _, size, _, x in parts]).astype(float)
        rids, ids, out, size, whole = (texts.column(c)[0].as_py() for c in ("rid", "doc_id", "held_out", "size", "texts"))
        events = pa.decompress(whole, decompressed_size=size, codec="zstd", asbytes=True).split(b"\xff")
        score, place = np.zeros(len(events)), pd.Index(code_of(keys))
        for pieces, owners in chunked(events):
            codes, sizes = grams_of(pieces)
            each = logs[place.get_indexer(codes)]
            score += np.bincount(owners, np.add.reduceat(each, np.concatenate([[0], np.cumsum(sizes)[:-1]])), len(events))
        count, seen, base, tail, times = [], [], [], [], []
        for event in events:
            own = event.split()
            tally = Counter(own)
            rest = [w for w in tally if w not in heads]  # a difference of key views would walk all of heads for each text
            count.append(len(own) + 1)
            base.append(end_log + sum(heads[w] * k for w, k in tally.items() if w in heads))
            seen.append(len(own) - sum(tally[w] for w in rest) + (ends > 0))
            tail.append(rest)
            times.append([tally[w] for w in rest])
        return pa.table(
            [pa.array(rids, pa.int64()), pa.array(ids, pa.int64()), pa.array(out, pa.bool_()), pa.array(count, pa.int64()), pa.array(seen, pa.int64()), pa.array(base, pa.float64()), pa.array(score), pa.array(tail, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))],
            names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "tail", "times"],
        )

    texts = blocks.where(F.col("bucket") == TEXTS).select("block", "size", "rid", "doc_id", "held_out", "texts")
    both = (df.repartition(partitions(spark), "block").groupBy("block") for df in (texts, answers))
    found = next(both).cogroup(next(both)).applyInArrow(scored, "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<binary>, times array<long>")
    found = written(found, "scored")
    tail = found.select("rid", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("rid", F.col("x.tail").alias("word"), F.col("x.times").alias("k"))
    rare = tail.join(words.where(F.col("c") <= tokens / HEAD), "word", "left").groupBy("rid").agg(
        F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("also")
    )
    return found.drop("tail", "times").join(rare, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(level)).alias("base_score"), "score",
    )


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_scores(documents(spark, sf_dir))


QUERIES = {"op6_ppm": op6_ppm}
