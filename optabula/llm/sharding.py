"""Sharding by a weighted hash tree of regions, racks and shards, in native expressions.

At every node a document draws an exponential number for each child, from a hash of the child's
name and the doc_id, divided by the child's weight; the least draw wins. A child wins in proportion
to its weight, and a changed weight moves documents only into or out of the subtrees that it
changes: the draws of all other children stay what they were.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import texts

# Blocks in which places within a shard are counted: bounds the counts to shards * BLOCKS rows.
BLOCKS = 4096


class Leaf(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_tree(shards: int, per_rack: int = 2, racks_per_region: int = 2) -> list[Leaf]:
    """Equal shards in racks of `per_rack`, in regions of `racks_per_region`, filled in order.

    A shard that opens a new region changes no other weight, so it only takes rows into itself.
    """
    return [Leaf(f"region{s // (per_rack * racks_per_region)}", f"rack{s // per_rack}", s)
            for s in range(shards)]


def draw(name: str, weight: float) -> Column:
    """Exponential with rate `weight`, from 52 bits of the md5 of the child's name and doc_id."""
    label = F.concat(F.lit(f"{name}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    bits = F.conv(F.substring(F.md5(label), 1, 13), 16, 10).cast("long")
    return -F.log((bits + 0.5) / 2.0**52) / F.lit(float(weight))


def _least(children: list[tuple[Column, Column]]) -> Column:
    """What belongs to the least draw; a single child needs no draw."""
    if len(children) == 1:
        return children[0][1]
    return F.array_min(F.array(*[F.struct(d.alias("d"), v.alias("v")) for d, v in children]))["v"]


def shard_of(leaves: list[Leaf]) -> Column:
    """The shard of `doc_id`: descends region, rack and shard by weighted draws."""
    if not leaves or any(x.weight <= 0 for x in leaves):
        raise ValueError("a tree needs leaves, and weights above 0")

    def groups(part: list[Leaf], level: str) -> dict[str, list[Leaf]]:
        found: dict[str, list[Leaf]] = {}
        for leaf in part:
            found.setdefault(getattr(leaf, level), []).append(leaf)
        return found

    def descend(part: list[Leaf], path: str, levels: list[str]) -> Column:
        if not levels:
            return _least([(draw(f"{path}/{x.shard}", x.weight), F.lit(x.shard)) for x in part])
        inner = groups(part, levels[0])
        chosen = _least([(draw(f"{path}/{name}", sum(x.weight for x in below)), F.lit(k))
                         for k, (name, below) in enumerate(inner.items())])
        out = F.lit(None).cast("int")
        for k, (name, below) in reversed(list(enumerate(inner.items()))):
            out = F.when(chosen == k, descend(below, f"{path}/{name}", levels[1:])).otherwise(out)
        return out

    return descend(leaves, "", ["region", "rack"])


def places(rows: DataFrame, key: str, order: list[str], block: Column) -> DataFrame:
    """`rows` with `slot`: gapless from 0 within `key`, counted in blocks of each key.

    Blocks come in order, and rows within a block by `order`; no task sees a whole key.
    """
    cut = rows.withColumn("block", block)
    sizes = cut.groupBy(key, "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(key, "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy(key, "block").orderBy(*order)
    return (cut.withColumn("within", F.row_number().over(within)).join(starts, [key, "block"])
            .withColumn("slot", F.col("before") + F.col("within") - 1)
            .drop("block", "within", "before"))


def shard_documents(docs: DataFrame, leaves: list[Leaf], grown: list[Leaf] | None = None,
                    ) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    `law` is `key`: doc_id and the tree decide the shard, `grown_shard` is the one in the tree
    `grown`. `slot` is the place within the shard. A null text has size 1 and the checksum of no
    bytes; null doc_ids share one key; repeated rows go to one shard and take a slot each; ties of
    doc_id are ordered by checksum and size; an empty table gives no rows; other columns are ignored.
    """
    rows = texts(docs).select(
        "doc_id", (F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        shard_of(leaves).cast("int").alias("shard"),
        (shard_of(grown) if grown else F.lit(None)).cast("int").alias("grown_shard"))
    block = F.pmod(F.coalesce("doc_id", F.lit(0)) % BLOCKS + F.col("text_crc32"), F.lit(BLOCKS))
    return places(rows, "shard", ["doc_id", "text_crc32", "size"], block)
