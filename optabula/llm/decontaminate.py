"""Benchmark decontamination: SimHash of item-sized windows, then exact weighted similarity.

1. Windows. A window has as many words as a benchmark item. It is formed where it ends with a shingle
   of the item, or begins the text, and holds enough of the item's shingles, at any place, to reach
   the similarity. A window that ends otherwise holds no more of them than the one a word before, so
   the first most similar window is formed, whatever the order of the item's parts. Shingle hashes
   of whole texts meet the items' in one join.
2. Fingerprints. The 64-bit SimHash of a window, shingles weighted by their count, is compared with
   all items of its size: fingerprints are cut into blocks, items are listed under every block value
   within `BLOCK_ERRORS` bits of theirs, and windows look their own blocks up. Two fingerprints
   within the radius have a block with no more errors than that, so none within it is lost.
3. Verification. The weighted Jaccard similarity of shingle counts decides.

Everything is column expressions; small tables (the benchmark) are broadcast behind a count.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE_CLASS, text_key, texts, written

SHINGLE = 5
# 64 bits in blocks, as (first bit, bits). Radius: blocks * (BLOCK_ERRORS + 1) - 1 bits.
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
BLOCK_ERRORS = 3
RADIUS = len(BLOCKS) * (BLOCK_ERRORS + 1) - 1
# Most rows of item shingles that are sent to every executor (40 bytes each).
BROADCAST_ROWS = 1_000_000


def lower_words(text: str = "text") -> Column:
    return F.filter(F.split(F.lower(F.col(text)), f"{WHITE_CLASS}+"), lambda w: w != "")


def shingles(rows: DataFrame, words: str, size: int) -> DataFrame:
    """One row per shingle of `size` words: the other columns, `pos` and the hash `h`."""
    m = F.greatest(F.size(words) - (size - 1), F.lit(0))
    parts = [F.slice(words, F.lit(k + 1), m).alias(f"w{k}") for k in range(size)]
    place = F.when(m > 0, F.sequence(F.lit(0), m - 1)).otherwise(F.array().cast("array<int>"))
    others = [c for c in rows.columns if c != words]
    return rows.select(*others, F.inline(F.arrays_zip(place.alias("pos"), *parts))).select(
        *others, "pos", F.xxhash64(*[f"w{k}" for k in range(size)]).alias("h"))


def simhash(grouped) -> DataFrame:
    """The majority of each bit of `h` over the rows of a group, as `fp`."""
    ones = [F.sum(F.col("h").bitwiseAND(F.lit(_signed(1 << b))).cast("boolean").cast("int")).alias(f"b{b}")
            for b in range(64)]
    counted = grouped.agg(F.count(F.lit(1)).alias("__n"), *ones)
    bits = [F.when(2 * F.col(f"b{b}") > F.col("__n"), F.lit(_signed(1 << b))).otherwise(F.lit(0))
            for b in range(64)]
    fp = reduce(lambda x, y: x.bitwiseOR(y), bits)
    return counted.withColumn("fp", fp).drop("__n", *[f"b{b}" for b in range(64)])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def blocks(fp: Column) -> Column:
    return F.array(*[F.struct(
        F.lit(k).alias("block"),
        F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1)).alias("value"))
        for k, (first, bits) in enumerate(BLOCKS)])


def near_blocks(items: DataFrame) -> DataFrame:
    """size, block, value, item_key, item_fp: every block value within BLOCK_ERRORS of an item's."""
    masks = [sum(1 << b for b in bits) for errors in range(BLOCK_ERRORS + 1)
             for bits in combinations(range(13), errors)]
    listed = items.select("size", "item_key", F.col("fp").alias("item_fp"),
                          F.inline(blocks(F.col("fp"))))
    return listed.withColumn("mask", F.explode(F.array(*[F.lit(m) for m in masks]))).withColumn(
        "value", F.col("value").bitwiseXOR(F.col("mask"))).drop("mask")


def near_items(prints: DataFrame, items: DataFrame, window: list[str]) -> DataFrame:
    """window, item_key: the items of a window's size whose fingerprint is within the radius.

    The listed items are merged, not broadcast: Spark reckons them as small as the items, but they are
    1,800 rows an item, all of which would pass through the driver.
    """
    return (prints.select(*window, "fp", F.inline(blocks(F.col("fp"))))
            .join(near_blocks(items).hint("merge"), ["size", "block", "value"])
            .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
            .select(*window, "item_key").distinct())


def _broadcast_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(doc_id, text_key, item_id, start, similarity): the best window of each item in a document.

    Words are lower-cased and split at blanks, tabs and line ends; shingles have five words, those
    of shorter items all of its words; documents shorter than an item are one window. Of equally
    similar windows the first counts. Items and texts without words (null, empty) match nothing;
    null doc_ids and item_ids stay null and are found as such; rows that repeat doc_id and text are one document;
    repeated items of one id count as one; an empty table gives no rows; other columns are ignored.
    """
    rows = texts(docs).select("doc_id", text_key(), lower_words().alias("w"))
    given = (benchmark.select(F.col("item_id").cast("long").alias("item_id"), lower_words().alias("w"))
             .where("size(w) > 0").dropDuplicates(["item_id", "w"])
             .withColumn("item_key", F.xxhash64("w"))
             .withColumn("size", F.size("w")))
    sizes = sorted(r[0] for r in given.select(
        F.least("size", F.lit(SHINGLE))).distinct().collect())  # at most SHINGLE values
    found = None
    for size in sizes:
        part = given.where(F.least("size", F.lit(SHINGLE)) == size)
        here = _of_size(rows, part, size, similarity)
        found = here if found is None else found.unionByName(here)
    if found is None:
        return docs.sparkSession.createDataFrame(
            [], "doc_id long, text_key long, item_id long, start int, similarity double")
    return found


def _full_windows(shingle: int, similarity: float) -> Column:
    """Starts of the windows that end with a shingle of the item and can reach the similarity.

    `places` are the sorted positions of the item's shingles in the document: no window shares more
    shingles with the item than it holds of them.
    """
    item_held = F.col("size") - (shingle - 1)
    held = F.least("n_words", "size") - (shingle - 1)
    need = F.greatest(F.lit(1), F.ceil(
        similarity / (1 + similarity) * (held + item_held) - 1e-6).cast("int"))
    ends = F.filter("places", lambda p, i: (i >= need - 1) & (
        F.get("places", i - need + 1) > p - item_held))
    return F.transform(ends, lambda p: F.greatest(F.lit(0), p - item_held + 1))


def _of_size(rows: DataFrame, given: DataFrame, shingle: int, similarity: float) -> DataFrame:
    item_shingles = written(shingles(given.select("item_id", "item_key", "size", "w"), "w", shingle),
                            "item-shingles")
    items = written(simhash(item_shingles.groupBy("item_id", "item_key", "size")), "items")
    held_in = _broadcast_small(item_shingles.select("h", "item_key", "size").distinct())
    met = (shingles(rows.withColumn("n_words", F.size("w")), "w", shingle).join(held_in, "h")
           .groupBy("doc_id", "text_key", "n_words", "size", "item_key")
           .agg(F.array_sort(F.collect_set("pos")).alias("places")))
    starts = written(met.select("doc_id", "text_key", "size", F.explode(
        _full_windows(shingle, similarity)).alias("start")).distinct(), "starts")
    same_doc = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (
        F.col("d.text_key") == F.col("s.text_key"))
    windows = (rows.alias("d").join(starts.alias("s"), same_doc)
               .select("s.doc_id", "s.text_key", "size", "start",
                       F.slice("w", F.col("start") + 1, F.col("size")).alias("w"))
               .dropDuplicates(["doc_id", "text_key", "size", "start"]))
    window_shingles = written(shingles(windows, "w", shingle), "window-shingles")
    window = ["doc_id", "text_key", "size", "start"]
    prints = simhash(window_shingles.groupBy(*window))
    near = near_items(prints, items, window)
    weights = window_shingles.groupBy(*window, "h").agg(F.count(F.lit(1)).alias("n"))
    item_weights = item_shingles.select("item_key", "h", "item_id").groupBy("item_key", "item_id", "h").agg(
        F.count(F.lit(1)).alias("item_n"))
    total = items.select("item_key", "item_id", "size")
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"x.{c}")) if c == "doc_id" else
            F.col(f"n.{c}") == F.col(f"x.{c}") for c in window]
    shared = (near.alias("n").join(weights.alias("x"), reduce(lambda a, b: a & b, same))
              .select("n.*", "x.h", "x.n")
              .join(item_weights, ["item_key", "h"])
              .groupBy(*window, "item_key", "item_id")
              .agg(F.sum(F.least("n", "item_n")).alias("shared")))
    # A window of fewer words than the item is a whole short document: it has fewer shingles.
    held = window_shingles.groupBy(*window).agg(F.count(F.lit(1)).alias("held"))
    both = shared.alias("n").join(held.alias("x"), reduce(lambda a, b: a & b, same)).select("n.*", "x.held")
    item_held = F.col("size") - (shingle - 1)
    scored = both.withColumn(
        "similarity", F.col("shared") / (F.col("held") + item_held - F.col("shared")))
    return (scored.where(F.col("similarity") >= similarity)
            .groupBy("doc_id", "text_key", "item_id")
            .agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start")).alias("best"))
            .select("doc_id", "text_key", "item_id", F.col("best.start").cast("int").alias("start"),
                    (-F.col("best.s")).alias("similarity")))
