"""Summing vectors over rows without funnelling them through one task.

Long vectors, and matrices as vectors of tiles, are cut into pieces. A partition gives its own sums
as pieces, the shuffle spreads them by piece over all tasks, and every task adds the pieces it got
one after the other: it holds one sum and one batch, however many partitions or groups there are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import kernels
from ..cluster import cut_lineage
from ..functions.vectors import NARROW_WIDTH

PIECES = "piece int, values array<double>"
KEYED_PIECES = f"block_id long, {PIECES}"
PARTIAL = "partial array<double>"


def added(partials: DataFrame, keyed: bool = False) -> DataFrame:
    """([block_id], piece, values) of many partitions -> one row of each, with the sum."""
    keys = ["block_id", "piece"] if keyed else ["piece"]
    return partials.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        kernels.add_pieces(keyed), KEYED_PIECES if keyed else PIECES)


def whole(sums: DataFrame, size: int, keyed: bool = False, finish: Callable | None = None,
          schema: str = PARTIAL) -> DataFrame:
    """Summed pieces -> one row per vector, made in the task of its key; see ``whole_vectors``."""
    placed = sums.repartition("block_id") if keyed else sums.repartition(1)
    ordered = placed.sortWithinPartitions(*(["block_id", "piece"] if keyed else ["piece"]))
    return ordered.mapInArrow(
        kernels.whole_vectors(size, keyed, finish), f"block_id long, {schema}" if keyed else schema)


def sum_partials(partials: DataFrame, size: int) -> DataFrame:
    """Pieces of equally long vectors -> one row ``partial`` with their sum."""
    return whole(added(partials), size)


def grouped_sums(df: DataFrame, chunk_sums, width: int, size: int, vector: Column,
                 number: Column, by: str | None = None, finish: Callable | None = None,
                 schema: str = PARTIAL) -> DataFrame:
    """Numpy sums per group, pre-aggregated in every partition: ([by], partial).

    A group of any size arrives at the shuffle as one vector per partition, cut into pieces.
    """
    columns = [vector.alias("vector"), number.cast("double").alias("number")]
    if by:
        columns = [*columns, F.col(by).cast("long").alias("block_id")]
    body = kernels.grouped_partials(chunk_sums, width, size, by is not None)
    partials = df.select(*columns).mapInArrow(body, KEYED_PIECES if by else PIECES)
    sums = whole(added(partials, by is not None), size, by is not None, finish, schema)
    return sums.withColumnRenamed("block_id", by) if by else sums


def sum_vectors(df: DataFrame, column: str, width: int) -> DataFrame:
    """Element-wise sum of a vector column, as one row with that column."""
    if width <= NARROW_WIDTH:
        sums = ", ".join(f"sum({column}[{i}])" for i in range(width))
        return df.selectExpr(f"array({sums}) AS {column}")
    partials = df.select(column).mapInArrow(kernels.array_partials(width), PIECES)
    return sum_partials(partials, width).withColumnRenamed("partial", column)


def cut_and_sum(df: DataFrame, packed: str, width: int,
                keep: Callable[[DataFrame], DataFrame] = cut_lineage) -> tuple[DataFrame, np.ndarray]:
    """Checkpoints ``df`` and sums the vector expression ``packed`` over its rows.

    ``keep`` may write it elsewhere and give what it has written.

    Narrow vectors are summed by the job that writes the checkpoint: the writing tasks are
    result tasks, whose metrics Spark counts once each, also when tasks are retried. Wide
    vectors are summed by a second job over the written rows.
    """
    if width > NARROW_WIDTH:
        kept = keep(df)
        partials = kept.selectExpr(f"{packed} AS packed").mapInArrow(
            kernels.array_partials(width), PIECES)
        return kept, collect_sum(partials, width)
    seen = Observation()
    observed = df.selectExpr("*", f"{packed} AS packed").observe(
        seen, *[F.expr(f"sum(packed[{i}]) AS s{i}") for i in range(width)])
    kept = keep(observed).drop("packed")
    found = seen.get
    sums = [found[f"s{i}"] for i in range(width)]
    if any(v is None or v != v for v in sums):
        raise ValueError("a sum over blocks is not a number")
    return kept, np.array(sums)


def collect_sum(partials: DataFrame, width: int) -> np.ndarray:
    """Pieces of vectors of ``width`` numbers -> their sum on the driver, 0 without any."""
    total = np.zeros(width)
    for piece, values in added(partials).collect():
        total[piece * kernels.PIECE:piece * kernels.PIECE + len(values)] = values
    return total


def collect_sums_by_key(partials: DataFrame) -> dict[int, np.ndarray]:
    """Keyed pieces -> the summed vector of every key, on the driver."""
    parts: dict[int, dict[int, list]] = {}
    for key, piece, values in added(partials, keyed=True).collect():
        parts.setdefault(key, {})[piece] = values
    return {key: np.concatenate([found[p] for p in sorted(found)]) for key, found in parts.items()}
