"""Best-fit packing into sequences of several permitted lengths.

Documents longer than the largest length are cut into pieces.  Pieces (ids and lengths only) are
dealt evenly into groups of some ten thousand, and each group is packed best-fit decreasing: a piece
goes to the open bin that it fills best; where none has room, a length is opened.  Which one is
settled jointly for the group: opening always the length of least cost for the tokens that it can
still get (those of pieces that fit the room left and that no open bin has room for) is one plan,
opening at most one of the permitted lengths is a plan for each of them, and the plan of the least
total cost is taken.  Costs are those after the end of a plan, where each bin is cut down to the
shortest permitted length that holds its contents.

Defined results: a null or empty text has no tokens and one piece of length 0, which takes part
like any other; rows without id have pieces without id; repeated rows are pieces of their own, and
are dealt like any others; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq.llm.common import documents, text_of, written

#: Permitted sequence lengths, in tokens (words).
LENGTHS = (256, 512, 1024, 2048, 4096)
#: Cost of a sequence besides its length, and of attention over it, in tokens: length + FIXED + SQUARE * length**2.
FIXED, SQUARE = 16.0, 1 / 65536
#: Pieces of a group, about.
GROUP = 20_000


def cost(length: int) -> float:
    return length + FIXED + SQUARE * length * length


class Pieces:
    """The pieces of a group in decreasing order, with the tokens of those still to come by size."""

    def __init__(self, sizes: list[int]):
        self.sizes = sizes
        self.tail = [*accumulate(reversed(sizes), initial=0)][::-1]  # tokens from each place on
        self.rising = sizes[::-1]

    def to_come(self, place: int, room: int) -> int:
        """Tokens of the pieces after ``place`` that are no larger than ``room``."""
        first = len(self.sizes) - bisect_right(self.rising, room)
        return self.tail[max(place + 1, first)]


def cheapest(pieces: Pieces, place: int, free: int, lengths) -> int:
    """The length to open for a piece: least cost a token that it can get to hold."""
    piece = pieces.sizes[place]

    def price(length):
        room = length - piece
        held = piece + min(room, max(0, pieces.to_come(place, room) - free))
        return cost(length) / max(1, held), length

    return min((c for c in lengths if c >= piece), key=price)


def pack_by(sizes: list[int], lengths, opening) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing with ``opening(pieces, place, free)`` for the lengths of new bins: bin and
    offset of each piece, and the length of each bin, cut down.  free: room in the open bins."""
    pieces = Pieces(sizes)
    with_room: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]  # open bins by room left
    rooms = free = 0  # bit r of rooms: some open bin has room r
    bins, offsets, used = [], [], []
    for place, piece in enumerate(sizes):
        fitting = rooms >> piece
        if fitting:
            room = piece + (fitting & -fitting).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
        else:
            room = opening(pieces, place, free)
            b = len(used)
            used.append(0)
            free += room
        bins.append(b)
        offsets.append(used[b])
        used[b] += piece
        free -= piece
        with_room[room - piece].append(b)
        rooms |= 1 << (room - piece)
    return bins, offsets, [lengths[bisect_left(lengths, u)] for u in used]


def pack(sizes: list[int], lengths=LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """For pieces in decreasing order the plan of the least total cost: bin and offset of each, and
    the length of each bin."""
    plans = [pack_by(sizes, lengths, lambda pieces, place, free: cheapest(pieces, place, free, lengths))]
    for usual in lengths:
        plans.append(pack_by(sizes, lengths, lambda pieces, place, _, usual=usual: next(c for c in lengths if c >= max(usual, pieces.sizes[place]))))
    return min(plans, key=lambda plan: sum(map(cost, plan[2])))


PACKED = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "piece", "start", "n_tokens")] + [("bin_id", pa.string()), ("bin_offset", pa.int64()), ("bin_length", pa.int64())]
)


def _packed(lengths):
    """Rows (doc_id, piece, start, n_tokens, grp) of one group in decreasing order of size, with their bins."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)  # ids stay as they are: they may be null
            bins, offsets, opened = pack(table.column("n_tokens").to_pylist(), lengths)
            group = table.column("grp")[0].as_py()
            columns = [table.column(c).combine_chunks() for c in ("doc_id", "piece", "start", "n_tokens")]
            columns += [pa.array([f"{group}-{b}" for b in bins]), pa.array(offsets, pa.int64()), pa.array(np.array(opened)[bins], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=PACKED)

    return run


def packed_sequences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lengths=LENGTHS, tokens=None) -> DataFrame:
    """A row for each piece: doc_id, piece, start, n_tokens, bin_id, bin_offset, bin_length.

    ``tokens``: a column with the length of a document; else the words of its text are counted."""
    largest = lengths[-1]
    n = tokens if tokens is not None else F.regexp_count(text_of(text), F.lit(r"[^\x20\x09-\x0D]+"))
    last = F.expr(f"greatest(0L, (total - 1) div {largest})")
    rows = written(docs.select(F.col(doc_id).cast("long").alias("doc_id"), n.cast("long").alias("total")), "lengths")
    many = rows.agg(F.sum(last + 1)).first()[0] or 0  # pieces, not documents: a long text has very many
    groups = max(1, -(-many // GROUP))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(
        "doc_id", "piece", (F.col("piece") * largest).alias("start"), F.least(F.col("total") - F.col("piece") * largest, F.lit(largest)).alias("n_tokens")
    )
    # dealt in turn (after a sort that makes it repeatable), so that no row's contents make a group large
    dealt = pieces.repartition(groups).withColumn("grp", F.spark_partition_id()).sortWithinPartitions(F.desc("n_tokens"), F.asc_nulls_first("doc_id"), "piece")
    return dealt.mapInArrow(_packed(lengths), "doc_id long, piece long, start long, n_tokens long, bin_id string, bin_offset long, bin_length long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_sequences(documents(spark, sf_dir))


QUERIES = {"op5_packing": op5_packing}
