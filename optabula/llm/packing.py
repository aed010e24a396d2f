"""Best-fit packing of documents into token sequences, planned on the histogram of lengths.

1. Documents are tokenized once, in Arrow batches; longer ones are cut into full pieces and a rest.
   Only the pieces' lengths and checksums leave the tasks.
2. The histogram of lengths (at most `capacity` rows) is planned on the driver: best fit with the
   longest first, over counts. A run of equal bins is one entry, so the plan does not grow with the
   documents: every length opens and splits at most three runs, and a run's room at least halves
   with each entry, so there are at most 3 * capacity * log2(capacity) entries.
3. Pieces are ranked within their length, in blocks so that no length meets in one task, and take
   the planned slots by joining on length and rank.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, texts, written
from .tokens import default_path, tokenizer

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = ("length long, rank_from long, rank_to long, first_bin long, first_offset long, "
        "per_bin long")


def token_pieces(docs: DataFrame, capacity: int, path: str, end_id: int) -> DataFrame:
    """The pieces of every document: ids of the whole text, then `end_id`, cut at `capacity`."""

    def pieces(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        encode, end = tokenizer(path).encode, end_id.to_bytes(4, "little")
        width = 4 * capacity
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = memoryview(encode(text.as_py()) + end)
                for piece, at in enumerate(range(0, len(ids), width)):
                    part = ids[at:at + width]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return texts(docs).mapInArrow(pieces, PIECES)


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple]:
    """Best fit decreasing over counts: rows of PLAN, one for a run of equal placements.

    Equal lengths fill the bin with the least sufficient room as often as they fit, which is what
    best fit does with them one by one.
    """
    plan, n_bins = [], 0
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: runs (first bin, bins)
    for length in sorted(histogram, reverse=True):
        count, rank = histogram[length], 0
        rooms = [r for r in runs if r >= length and runs[r]]
        heapq.heapify(rooms)
        while rank < count:
            left = count - rank
            while rooms and not runs[rooms[0]]:
                heapq.heappop(rooms)
            if rooms:
                room = rooms[0]
                first, bins = runs[room].pop()
            else:
                room, first = capacity, n_bins
                bins = max(1, left // (capacity // length))
                n_bins += bins
            per = room // length
            if left < per:  # the last pieces of this length share one bin
                per, used = left, 1
            else:
                used = min(bins, left // per)
            plan.append((length, rank, rank + used * per, first, capacity - room, per))
            rank += used * per
            rest = room - per * length
            if used < bins:
                runs[room].append((first + used, bins - used))
            if rest:
                runs[rest].append((first, used))
    return plan


def ranked_within(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """`rows` with `rank`, gapless from 0 within `key`, counted in hashed blocks of each key."""
    blocks = shuffle_partitions(rows.sparkSession)
    cut = rows.withColumn("block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    sizes = cut.groupBy(key, "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(key, "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy(key, "block").orderBy(*order)
    return (cut.withColumn("within", F.row_number().over(within))
            .join(starts, [key, "block"])
            .withColumn("rank", F.col("before") + F.col("within") - 1)
            .drop("block", "within", "before"))


def pack(docs: DataFrame, capacity: int = 4096, tokenizer_path: str | None = None,
         end_id: int = 1) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null text is empty and
    gives one piece, `end_id` alone; a null doc_id stays null; repeated rows are packed each; ties
    of length take slots in the order of (doc_id, piece, ids_crc32); an empty table gives no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = written(
        token_pieces(docs, capacity, tokenizer_path or default_path(), end_id), "pieces")
    histogram = {r.length: r.n for r in
                 pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # At most 3 * capacity * log2(capacity) rows, as planned above: 150,000 at 4096.
    plan = F.broadcast(spark.createDataFrame(plan_bins(histogram, capacity), PLAN))
    ranked = ranked_within(pieces, "length", ["doc_id", "piece", "ids_crc32"])
    nth = F.col("rank") - F.col("rank_from")
    return (
        ranked.join(plan, "length")
        .where("rank >= rank_from AND rank < rank_to")
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("first_bin") + F.floor(nth / F.col("per_bin"))).cast("long").alias("sequence_id"),
            (F.col("first_offset") + nth % F.col("per_bin") * F.col("length")).alias("offset"))
    )
