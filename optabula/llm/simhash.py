"""SimHash near-duplicates by a Gray-order hierarchical index of the distinct fingerprints.

1. Fingerprints are computed in Arrow batches; equal ones are one entry from there on.
2. Upper nodes of the index are (mask, masked bits): the 64 bits are cut into `distance + 2` blocks,
   and a mask is two whole blocks. Fingerprints within the distance differ in at most `distance`
   blocks, so two blocks agree and some upper node holds both. A node with more than `node_limit`
   entries is cut again by the same rule over the bits that its mask leaves free.
3. Within a node, entries are sorted by Gray rank and halved into lower nodes; a lower node keeps
   the bits that all its entries share. Two lower nodes whose shared bits differ in more than the
   distance are pruned with all their entries; leaves compare bits.
4. A node emits links of a spanning forest of its entries, not all pairs; components give the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_key, texts, written
from .components import connected

LEAF = 64
COUNTED = 255 * 256  # shingles whose bits are unpacked at once


def fingerprint(text: str, shingle: int) -> int:
    """The unsigned 64-bit SimHash of a text: majority of the XXH64 bits of its word shingles."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1].tolist()
    k = min(shingle, len(words))
    ends = ends[k - 1:].tolist()
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends)], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNTED):
        bits = np.unpackbits(hashes[at:at + COUNTED].view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        whole = len(bits) // 255 * 255  # 255 ones still fit a byte
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(
            axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, text_key and the fingerprint `fp` as a signed long."""

    def hashed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [fingerprint(t.as_py(), shingle) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(found, "<u8").view("<i8"))],
                names=["doc_id", "text_key", "fp"])

    return texts(docs).select("doc_id", text_key(), "text").mapInArrow(
        hashed, "doc_id long, text_key long, fp long")


def masks(free: int, distance: int) -> list[int]:
    """Masks of two of `distance + 2` blocks of the bits set in `free`."""
    bits = [b for b in range(64) if free >> b & 1]
    blocks = np.array_split(bits, distance + 2)
    return [sum(1 << int(b) for k in pair for b in blocks[k])
            for pair in combinations(range(distance + 2), 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(fp: Column) -> Column:
    """The place of a bit pattern in Gray order: exclusive or of all its right shifts."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def index_nodes(fps: DataFrame, distance: int, node_limit: int) -> DataFrame:
    """(mask, bits, fp): the entries of all nodes that hold two or more fingerprints."""

    def members(rows: DataFrame, node_masks: Column) -> DataFrame:
        return rows.select(F.explode(node_masks).alias("mask"), "fp").withColumn(
            "bits", F.col("fp").bitwiseAND(F.col("mask")))

    def shared(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return rows.join(sizes, ["mask", "bits"])

    upper = masks((1 << 64) - 1, distance)
    top = shared(members(fps, F.array(*[F.lit(_signed(m)) for m in upper])))
    finer = F.create_map(*[
        x for m in upper for x in (
            F.lit(_signed(m)),
            F.array(*[F.lit(_signed(m | below)) for below in masks(~m & ((1 << 64) - 1), distance)]))])
    large = shared(members(top.where(F.col("n") > node_limit), finer[F.col("mask")]).distinct())
    return top.where(F.col("n") <= node_limit).unionByName(large).drop("n")


def forest(entries: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links (entry, least entry) of a node's entries in Gray order, by pruned tree search."""
    parent = list(range(len(entries)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def node(lo: int, hi: int) -> tuple:
        part = entries[lo:hi]
        same = ~(np.bitwise_or.reduce(part) ^ np.bitwise_and.reduce(part))
        return lo, hi, part[0] & same, same

    def halves(x: tuple) -> list[tuple]:
        middle = (x[0] + x[1]) // 2
        return [node(x[0], middle), node(middle, x[1])]

    todo = [(node(0, len(entries)),) * 2]
    while todo:
        a, b = todo.pop()
        if np.bitwise_count((a[2] ^ b[2]) & a[3] & b[3]) > distance:
            continue
        if a[1] - a[0] <= LEAF and b[1] - b[0] <= LEAF:
            differ = np.bitwise_count(entries[a[0]:a[1], None] ^ entries[None, b[0]:b[1]])
            for i, j in np.argwhere(differ <= distance).tolist():
                x, y = root(a[0] + i), root(b[0] + j)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        elif a[:2] == b[:2]:
            x, y = halves(a)
            todo += [(x, x), (x, y), (y, y)]
        elif a[1] - a[0] >= b[1] - b[0]:
            todo += [(x, b) for x in halves(a)]
        else:
            todo += [(a, x) for x in halves(b)]
    return [(i, r) for i in range(len(entries)) if (r := root(i)) != i]


def links(fps: DataFrame, distance: int = 4, node_limit: int = 4096) -> DataFrame:
    """(u, v) links that connect all distinct fingerprints within `distance` bits of each other."""

    def linked(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = np.zeros((0, 3), np.int64)

        def of(rows: np.ndarray) -> np.ndarray:
            """Links within the runs of equal (mask, bits)."""
            starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
            ends = np.r_[starts[1:], len(rows)]
            fp = rows[:, 2].view(np.uint64)
            two = starts[ends - starts == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
            out = [np.stack([rows[two, 2], rows[two + 1, 2]], axis=1)]
            for lo, hi in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
                pairs = forest(fp[lo:hi], distance)
                if pairs:
                    out.append(rows[lo:hi, 2][np.array(pairs)])
            return np.concatenate(out)

        def batch_of(pairs: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["u", "v"])

        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            held = np.concatenate([held, rows])
            last = np.flatnonzero((held[:, :2] != held[-1, :2]).any(axis=1)) if len(held) else []
            cut = int(last[-1]) + 1 if len(last) else 0  # the last run may go on in the next batch
            if cut:
                yield batch_of(of(held[:cut]))
                held = held[cut:]
        if len(held):
            yield batch_of(of(held))

    return (index_nodes(fps, distance, node_limit)
            .repartition("mask", "bits").sortWithinPartitions("mask", "bits", gray_rank(F.col("fp")))
            .select("mask", "bits", "fp").mapInArrow(linked, "u long, v long"))


def simhash_groups(docs: DataFrame, shingle: int = 4, distance: int = 4,
                   node_limit: int = 4096) -> DataFrame:
    """One row per document: doc_id, text_key, fp, root, component_id.

    `root` is the component's least fingerprint (signed).
    `component_id` is the least doc_id among the documents that links of at most `distance` bits
    reach. A null text is empty; texts without words have fingerprint 0 and are linked like any
    other; documents with null doc_id take part, and a component of such documents only has a null
    id; repeated rows are returned each; an empty table gives no rows; other columns are ignored.
    """
    rows = written(fingerprints(docs, shingle), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected(links(fps, distance, node_limit))
    named = fps.join(roots, fps.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(groups, "root").select("fp", "root", "component_id"), "fp").select(
        "doc_id", "text_key", "fp", "root", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
